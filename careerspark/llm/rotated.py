"""Approximate nearest neighbours from randomly rotated one-bit codes.

Each vector, less the mean of all, is rotated at random and reduced to the signs of its components: one bit each, with
two scalars, its length and how well the signs point its way. A query, rotated likewise, gets an estimate of its inner
product with every vector and a bound on the error of that estimate, which holds with high probability. In each block,
the best estimates are measured exactly; then every vector whose bound allows it to be nearer than the k-th measured one
is measured too. Every row is indexed; the rotation comes from a fixed seed.

Results of odd rows: vectors as in ``vectors.usable`` and zero vectors take no part; a query meets vectors of its own
length only; rows that repeat a vec_id are candidates each; equal distances rank by vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .vectors import BLOCK, QUERY_BLOCK, meetings, one_per_id, per_row, read, stored_blocks, usable

SEED = 20_240_917
WIDTH = 2.5         # half-width of the error bound, in standard deviations of the estimate
FIRST = 4           # times k estimates are measured before bounds are used

INDEX = "block long, dim int, n int, ids binary, vectors binary, bits binary, lengths binary, fits binary"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of the unit vectors with their signs' unit vectors."""
    v = v - centre
    lengths = np.sqrt((v * v).sum(axis=1))
    turned = (v / np.where(lengths > 0, lengths, 1)[:, None]) @ rotation(v.shape[1])
    return np.packbits(turned > 0, axis=1), lengths, np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])


def estimates(bits: np.ndarray, lengths: np.ndarray, fits: np.ndarray, q: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of queries to coded vectors, and lower bounds."""
    dim = q.shape[1]
    q = q - centre
    q_lengths = np.sqrt((q * q).sum(axis=1))
    turned = (q / np.where(q_lengths > 0, q_lengths, 1)[:, None]) @ rotation(dim)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    fit = np.where(fits > 0, fits, 1)
    inner = (turned.astype(np.float32) @ signs.T) / np.sqrt(dim) / fit
    error = WIDTH * np.sqrt(np.maximum(1 - fit ** 2, 0)) / fit / np.sqrt(max(dim - 1, 1))
    square, twice = q_lengths[:, None] ** 2 + lengths ** 2, 2 * q_lengths[:, None] * lengths
    return square - twice * inner, square - twice * np.minimum(inner + error, 1)


def nearest(ids: np.ndarray, v: np.ndarray, q_id: int, q: np.ndarray, estimate: np.ndarray, lower: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest of a block by measuring candidates only."""
    def measured(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((v[rows] - q) ** 2).sum(axis=1))

    others = np.flatnonzero(ids != q_id)
    if not len(others):
        return ids[:0], np.zeros(0)
    some = min(len(others), FIRST * k)
    first = others[np.argpartition(estimate[others], some - 1)[:some]]
    away = measured(first)
    limit = np.partition(away, min(k, some) - 1)[min(k, some) - 1] if some >= k else np.inf
    slack = 1e-9 * (1 + abs(limit) ** 2) if np.isfinite(limit) else 0
    more = np.setdiff1d(others[lower[others] <= limit ** 2 + slack], first)
    rows, away = np.concatenate([first, more]), np.concatenate([away, measured(more)])
    order = np.lexsort((ids[rows], away))[:k]
    return ids[rows[order]], away[order]


def index(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of all vectors with their codes, written to the shared folder."""
    def coded(row: dict) -> pa.RecordBatch:
        bits, lengths, fits = codes(read(row)[1], centres[row["dim"]])
        return pa.RecordBatch.from_pylist([row | {"bits": bits.tobytes(), "lengths": lengths.tobytes(), "fits": fits.tobytes()}],
                                          schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "vectors", "bits", "lengths", "fits")]]))

    return saved(stored_blocks(rows, "ann-blocks", BLOCK).mapInArrow(per_row(coded), INDEX), "ann-index")


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each length."""
    at = rows.select(F.size("embedding").alias("dim"), F.posexplode("embedding").alias("at", "x"))
    means = at.groupBy("dim", "at").agg(F.avg("x").alias("x")).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))
    return {r["dim"]: np.array([m["x"] for m in r["m"]]) for r in means.collect()}     # one row per length of vectors


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``vectors`` has vec_id and embedding. Returns query_id, rank (from 1), vec_id and score, the Euclidean distance
    of the original vectors, for each row of ``is_query`` against all other rows."""
    rows = usable(vectors).filter(F.exists("embedding", lambda x: x != 0))
    centres = _centres(rows)
    blocks = index(rows, centres)
    queries = stored_blocks(one_per_id(rows.filter(is_query)), "ann-queries", QUERY_BLOCK)

    def block_nearest(row: dict) -> pa.RecordBatch | None:
        ids, v = read(row)
        q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dim"])
        bits = np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1)
        estimate, lower = estimates(bits, np.frombuffer(row["lengths"]), np.frombuffer(row["fits"]), q, centres[row["dim"]])
        found = [nearest(ids, v, int(a), b, e, low, k) for a, b, e, low in zip(q_ids, q, estimate, lower)]
        n = [len(f[0]) for f in found]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
            names=["query_id", "vec_id", "score"])

    met = meetings(blocks, queries, ["n", "ids", "vectors", "bits", "lengths", "fits"],
                   [F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")])
    found = met.mapInArrow(per_row(block_nearest), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
