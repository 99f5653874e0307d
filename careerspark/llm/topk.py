"""Exact search for the k highest integer inner products, by distributed histograms.

All scores are made in each pass and none are kept. A pass counts, for every query, scores by bin within the range where
the k-th value is known to lie; bins get narrower from pass to pass until a bin is one score, which is the k-th value
itself. A last pass keeps the scores above it and, of those equal to it, the smallest ids. A block sends no bin below
its own k best scores, since the k-th value of all is never below the k-th value of a block.

Results of odd rows: see ``vectors.usable`` for vectors that take no part; a query meets vectors of its own length only;
rows that repeat a vec_id are candidates each; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .vectors import BLOCK, QUERY_BLOCK, meetings, one_per_id, per_row, read, stored_blocks, usable

BITS = 12           # a pass tells 2 ** BITS bins apart
SCALE = 256
LEAST = -(1 << 62)  # below every score


def quantised(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v)


def _scores(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; ``LEAST`` for a query and its own row."""
    q, v = quantised(q), quantised(v)
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < 2.0 ** 53:
        scores = (q @ v.T).astype(np.int64)         # exact in doubles
    else:
        scores = q.astype(np.int64) @ v.astype(np.int64).T
    scores[q_ids[:, None] == ids[None, :]] = LEAST
    return scores


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query in a block, ``LEAST`` if there are fewer."""
    if scores.shape[1] <= k:
        return np.full(len(scores), LEAST)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _histogram(k: int, shift: int):
    """Scores of the range in question, by bin of 2 ** shift: query_id, bin, n."""
    def run(row: dict) -> pa.RecordBatch | None:
        ids, v = read(row)
        q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dim"])
        scores = _scores(q_ids, q, ids, v)
        low, high = np.array(row["low"], np.int64), np.array(row["high"], np.int64)
        mine = (scores >= np.maximum(_best(scores, k), np.maximum(low, LEAST + 1))[:, None]) & (scores < high[:, None])
        at, c = np.nonzero(mine)
        if not len(at):
            return None
        pairs, n = np.unique(np.stack([at, scores[at, c] >> shift]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[pairs[0]]), pa.array(pairs[1]), pa.array(n)], names=["query_id", "bin", "n"])
    return run


def _kept(k: int):
    """Scores above the k-th value, and the k smallest ids at it."""
    def run(row: dict) -> pa.RecordBatch | None:
        ids, v = read(row)
        q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dim"])
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        scores, least = _scores(q_ids, q, ids, v), np.array(row["low"], np.int64)[:, None]
        tied = scores == least
        mine = ((scores > least) | tied & (np.cumsum(tied, axis=1) <= k)) & (scores > LEAST)
        at, c = np.nonzero(mine)
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[c]), pa.array(scores[at, c])],
                                          names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``vectors`` has vec_id and embedding. Returns query_id, rank (from 1), vec_id and score for each row of
    ``is_query`` against all other rows; ties go to the smaller vec_id."""
    rows = usable(vectors)
    blocks = stored_blocks(rows, "topk-blocks", BLOCK)
    queries = stored_blocks(one_per_id(rows.filter(is_query)), "topk-queries", QUERY_BLOCK)
    most = blocks.select(F.max("n")).first()[0]
    if most is None or queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_ids = queries.mapInArrow(per_row(lambda r: pa.RecordBatch.from_arrays(
        [pa.array(np.full(r["n"], r["block"])), pa.array(np.arange(r["n"])), pa.array(read(r)[0])], names=["block", "at", "query_id"])),
        "block long, at long, query_id long")
    q_ids = saved(q_ids, "topk-query-ids")
    top = 1 << 61
    # Range [low, high) of the k-th value of each query, and how many scores are known to lie at or above high.
    state = q_ids.withColumns({"low": F.lit(LEAST), "high": F.lit(top), "above": F.lit(0).cast("long")})
    shift = max(0, _score_bits(blocks) - BITS)

    def met(state: DataFrame) -> DataFrame:
        ranges = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("r"))
        asked = queries.join(ranges, "block")
        return meetings(blocks, asked, ["n", "ids", "vectors"],
                        [F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("r.low").alias("low"), F.col("r.high").alias("high")])

    while True:
        bins = met(state).mapInArrow(per_row(_histogram(k, shift)), "query_id long, bin long, n long")
        bins = bins.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        reached = (bins.join(state.select(F.col("query_id").alias("_q"), "above"), F.col("query_id") == F.col("_q"))
                   .withColumn("_sum", F.col("above") + F.sum("n").over(down))
                   .filter(F.col("_sum") >= k).groupBy("_q").agg(F.max_by(F.struct("bin", (F.col("_sum") - F.col("n")).alias("over")), "bin").alias("hit")))
        # A query with fewer than k candidates reaches no bin: all its scores are kept.
        state = saved(state.join(reached, F.col("query_id") == F.col("_q"), "left").select(
            "block", "at", "query_id", F.when(F.col("hit").isNull(), F.lit(LEAST)).otherwise(F.shiftleft(F.col("hit.bin"), shift)).alias("low"),
            F.when(F.col("hit").isNull(), F.lit(LEAST + 1)).otherwise(F.shiftleft(F.col("hit.bin") + 1, shift)).alias("high"),
            F.coalesce(F.col("hit.over"), F.lit(k).cast("long")).alias("above")), "topk-ranges")
        if shift == 0:
            break
        shift = max(0, shift - BITS)
    found = met(state).mapInArrow(per_row(_kept(k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _score_bits(blocks: DataFrame) -> int:
    """Bits of the largest possible score."""
    def longest(row: dict) -> pa.RecordBatch:
        _, v = read(row)
        return pa.RecordBatch.from_arrays([pa.array([float((quantised(v) ** 2).sum(axis=1).max(initial=0))])], names=["x"])

    square = blocks.mapInArrow(per_row(longest), "x double").agg(F.max("x")).first()[0] or 1.0
    return min(61, int(np.ceil(np.log2(max(square, 1.0)))) + 2)
