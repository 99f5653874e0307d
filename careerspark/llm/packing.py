"""Best-fit packing of texts into training sequences of several permitted lengths.

1. A text's tokens (words and an end) are cut into pieces of at most the largest permitted length.
2. The counts of pieces by length, at most as many as that length has tokens, are planned on the driver: lengths from
   large to small, each piece into the open bin with the least room that still holds it. If none does, a bin is opened
   whose size costs least per token, foreseeing what smaller pieces would fill it; a bin costs its length and a fixed
   part. At the end each bin shrinks to the smallest permitted length that holds its contents. The plan treats equal
   bins as one run, so it has as many rows for a thousand texts as for a billion.
3. Each piece takes its place by its number among the pieces of its length. Numbers come from sums over spread groups,
   so that a length shared by very many texts is no large group.

Results of odd rows: a null or empty text is its end alone, one token; repeated rows are packed one by one; the order of
pieces of one length is by a hash of id and piece, then id and piece; rows alike in both take their numbers in any order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16               # what a sequence costs besides its length, in tokens
GROUP_ROWS = 200_000        # pieces numbered by one task, about


def opening_size(length: int, counts: dict[int, int], lengths: Sequence[int], sizes: Sequence[int]) -> int:
    """The permitted size whose bin costs least per token it would hold, filled up with the longest pieces that fit.

    ``lengths`` are the ascending lengths still to be placed after this one.
    """
    best, least = sizes[-1], float("inf")
    for size in sizes:
        if size < length:
            continue
        room = size - length
        same = min(counts[length] - 1, room // length)
        room -= same * length
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and room:
            room -= min(counts[lengths[at]], room // lengths[at]) * lengths[at]
            at = min(at, bisect_left(lengths, room + 1)) - 1
        used = size - room
        cost = (min(s for s in sizes if s >= used) + OVERHEAD) / used
        if cost < least:
            best, least = size, cost
    return best


def plan(counts: dict[int, int], sizes: Sequence[int] = SIZES) -> pd.DataFrame:
    """Where pieces of each length go: ``n`` pieces from number ``first`` on (from 0), one to each bin from ``bin`` on,
    at ``start``; ``capacity`` of these bins, after shrinking."""
    sizes, counts = sorted(sizes), {k: v for k, v in counts.items() if v}
    lengths = sorted(counts)
    # Open bins in runs: (room, first bin, number of bins, size); placed pieces: (length, first, bin, n, start).
    runs: list[tuple[int, int, int, int]] = []
    full: list[tuple[int, int, int, int]] = []
    placed: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while lengths:
        length = lengths.pop()
        number, left = 0, counts[length]
        while left:
            at = bisect_left(runs, (length,))
            if at < len(runs):
                room, first, n, size = runs.pop(at)
                if n > left:
                    insort(runs, (room, first + left, n - left, size))
                    n = left
            else:
                counts[length] = left
                size = opening_size(length, counts, lengths, sizes)
                # As many bins as pieces of this length need when each takes what fits; the rest stays to be placed.
                room, first, n = size, bins, -(-left // (size // length))
                bins += n
            placed.append((length, number, first, n, size - room))
            number, left = number + n, left - n
            room -= length
            if room:
                insort(runs, (room, first, n, size))
            else:
                full.append((room, first, n, size))
    ends = sorted((first, n, min(s for s in sizes if s >= size - room)) for room, first, n, size in [*runs, *full])
    firsts = [first for first, _, _ in ends]
    rows = []
    for length, number, first, n, start in placed:      # cut where runs of bins were cut later
        at = bisect_left(firsts, first + 1) - 1
        done = 0
        while done < n:
            begin, size, capacity = ends[at]
            take = min(n - done, begin + size - (first + done))
            rows.append((length, number + done, take, first + done, start, capacity))
            done, at = done + take, at + 1
    return pd.DataFrame(rows, columns=["length", "first", "n", "bin", "start", "capacity"])


def pieces(docs: DataFrame, longest: int, text: str = "text") -> DataFrame:
    """doc_id, piece (from 0) and length of the pieces of each text."""
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    counted = docs.select("doc_id", tokens.alias("_tokens"))
    each = counted.select("doc_id", "_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_tokens - 1) div {longest}"))).alias("piece"))
    return each.select("doc_id", "piece", F.least(F.lit(longest).cast("long"), F.col("_tokens") - F.col("piece") * longest).alias("length"))


def pack(docs: DataFrame, sizes: Sequence[int] = SIZES, text: str = "text") -> DataFrame:
    """Places every piece of every text: doc_id, piece, n_tokens, bin, start (in the bin) and capacity (of the bin)."""
    cut = pieces(docs, max(sizes), text)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most max(sizes) rows
    placed = plan(counts, sizes)
    spark = docs.sparkSession
    groups = spark.createDataFrame([(k, v // GROUP_ROWS + 1) for k, v in counts.items()], "length long, groups long")
    spread = cut.join(F.broadcast(groups), "length").withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups")))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "group").agg(F.count("*").alias("_n")).select(
        "length", "group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "group").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    numbered = (spread.withColumn("_in", F.row_number().over(within) - 1).join(offsets, ["length", "group"])
                .select("doc_id", "piece", "length", (F.col("_in") + F.col("_before")).alias("_number")))
    steps = spark.createDataFrame(list(placed.itertuples(index=False, name=None)),
                                  "_length long, _first long, _n long, _bin long, start long, capacity long")
    # the plan is bounded by the lengths and sizes, not by the texts
    where = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_first") + F.col("_n"))
    return numbered.join(F.broadcast(steps), where).select(
        "doc_id", "piece", F.col("length").alias("n_tokens"), (F.col("_bin") + F.col("_number") - F.col("_first")).alias("bin"),
        "start", "capacity")
