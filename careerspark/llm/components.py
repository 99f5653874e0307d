"""Connected components of an undirected graph, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_ROUNDS = 60     # rounds grow with the logarithm of the number of nodes; more mean an error


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has a and b (long). Returns node and root, its smallest reachable node; nodes without edges are absent.

    Alternates two steps until nothing changes: every node passes its smallest neighbour to its larger neighbours,
    then to its smaller ones and itself. Each round is written to the shared folder. A node with very many edges
    counts in every task before the shuffle, and its edges are joined to one row.
    """
    now = saved(edges.filter("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b")).distinct()
        before = state
        now = saved(_small(_large(now)), "edges")
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min(F.least("a", "b")).alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("_a"))
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("_a", "m"))
            .filter("a <> b").distinct())
