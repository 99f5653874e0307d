"""Blocks of vectors, and their meeting with a stated set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BLOCK = 4096            # vectors of a block
QUERY_BLOCK = 512       # queries of a block
PART_ROWS = 100_000     # vectors that meet the queries in one task, about

BLOCKS = "block long, dim int, n int, ids binary, vectors binary"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: an id, and a vector of at least one finite component
    and no others."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))


def one_per_id(queries: DataFrame) -> DataFrame:
    """A query id that repeats counts once, with the smallest of its vectors."""
    return queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def blocked(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length, as bytes of longs and doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                values = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
                for i in range(0, len(rows), size):
                    part = slice(i, i + size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(rows[part])], pa.int32()),
                        pa.array([ids[rows[part]].astype(np.int64).tobytes()]), pa.array([values[part].astype(np.float64).tobytes()])],
                        names=["block", "dim", "n", "ids", "vectors"])
                    number += 1

    return vectors.mapInArrow(run, BLOCKS)


def read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])


def meetings(blocks: DataFrame, queries: DataFrame, columns: list[str | Column], query_columns: list[str | Column]) -> DataFrame:
    """Every block with every block of queries of the same length.

    Blocks are dealt over parts and the queries, a stated share of the rows, go to each part once, so a part holds a
    bounded number of vectors and the join key is never one value for all.
    """
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(12, rows // PART_ROWS)
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).select("part", "dim", *columns)
    sent = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(sent.select("part", "dim", *query_columns), ["part", "dim"])


def per_row(run: Callable[[dict], pa.RecordBatch | None]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = run(batch.slice(k, 1).to_pylist()[0])
                if out is not None:
                    yield out
    return over


def stored_blocks(vectors: DataFrame, name: str, size: int) -> DataFrame:
    return saved(blocked(vectors, size), name)
