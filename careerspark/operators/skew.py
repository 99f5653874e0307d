"""Groups too large for one task: finding them, joining around them, cutting them into cells.

All of it keeps results whole. Small groups take the plain Spark operators; only groups with more than
``spark.careerspark.maxGroupRows`` rows are treated separately, and without any nothing is added to the plan but
one counting pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import session_stages

MAX_GROUP_ROWS_CONF = "spark.careerspark.maxGroupRows"
MAX_GROUP_ROWS = 5_000_000
PARTS_PER_TASK_SHARE = 4    # parts of an oversized key in a join of many to many, per task's share of its rows
CELLS_PER_TASK_SHARE = 2    # cells per task's share of rows: finer than needed, because a sample places them


AUTO = "auto"   # look for oversized groups; None = there are none, or a result of ``oversized``


def key_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ---- finding them ----------------------------------------------------------


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_GROUP_ROWS_CONF, str(MAX_GROUP_ROWS)))


def oversized(df: DataFrame, keys: str | Sequence[str], rows_of: DataFrame | None = None) -> DataFrame | None:
    """Keys of the groups with too many rows for one task, as a small literal table; None when there are none.

    One pass over the key columns, counted in each task before the shuffle. At most ``rows / maxGroupRows`` groups
    qualify, which bounds fetching and broadcasting them. Count the
    cheapest table with the same key columns, such as a log before its joins, and use the answer for several operators.
    ``rows_of`` is a stored table with at least as many rows as ``df``: when it is small as a whole, which its files
    tell without being read, nothing needs to be counted by key.
    """
    keys = key_list(keys)
    if rows_of is not None and rows_of.count() <= group_limit(df):
        return None
    found = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_limit(df))
             .select(*keys, "_n").collect())
    return _as_heavy(df, keys, found)


def oversized_of(counts: DataFrame, keys: str | Sequence[str], count: str) -> DataFrame | None:
    """As ``oversized``, from a table that has the number of rows of each group already."""
    keys = key_list(keys)
    found = counts.filter(F.col(count) > group_limit(counts)).select(*keys, F.col(count).cast("long")).collect()
    return _as_heavy(counts, keys, found)


def _as_heavy(df: DataFrame, keys: Sequence[str], found: list) -> DataFrame | None:
    if not found:
        return None
    schema = T.StructType([*[T.StructField(f"_hot_{k}", df.schema[k].dataType) for k in keys], T.StructField("_hot_count", T.LongType())])
    return df.sparkSession.createDataFrame([tuple(r) for r in found], schema)


def _matching(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    return cond


# ---- joining around them ---------------------------------------------------


def lookup_join(df: DataFrame, side: DataFrame, on: dict[str, str], how: str = "left", null_safe: bool = False,
                heavy: DataFrame | None | str = AUTO, where: Column | None = None, unique: bool = True) -> DataFrame:
    """Equality join with a smaller table; ``on`` is ``{column of df: column of side}``, ``where`` a further condition.

    Rows with ordinary keys are joined as the planner sees fit. Rows with oversized keys, a missing key among them,
    are kept apart. When the side has at most one row per key, they stay where they are and meet a broadcast of the
    few side rows of these keys. Otherwise (``unique=False``) they are spread over parts of their key, as many as its
    rows need, and the side rows of these keys are repeated for each part.
    """
    keys = list(on)
    if isinstance(heavy, str):
        heavy = oversized(df, keys)
    cond = F.lit(True) if where is None else where
    for mine, theirs in on.items():
        cond = cond & (F.col(mine).eqNullSafe(F.col(theirs)) if null_safe else F.col(mine) == F.col(theirs))
    if heavy is None:
        return df.join(side, cond, how)
    hot = F.broadcast(heavy)
    of_hot_key = F.lit(True)
    for mine, theirs in on.items():
        of_hot_key = of_hot_key & F.col(theirs).eqNullSafe(F.col(f"_hot_{mine}"))
    rows, few = df.join(hot, _matching(keys), "left_semi"), side.join(hot, of_hot_key, "left_semi")
    if unique:
        inside = rows.join(F.broadcast(few), cond, how)
    else:
        # Decided by content and partition, not by chance: a part that is computed again gives the same salts.
        content = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        parts = F.greatest(F.lit(1), F.ceil(F.col("_hot_count") * PARTS_PER_TASK_SHARE / group_limit(df))).cast("int")
        spread = F.broadcast(heavy.withColumn("_parts", parts).drop("_hot_count"))
        drop = [f"_hot_{k}" for k in keys]
        rows = (df.join(spread, _matching(keys)).drop(*drop)
                .withColumn("_salt", F.pmod(F.xxhash64(*content) + F.spark_partition_id(), F.col("_parts")).cast("int")).drop("_parts"))
        few = (side.join(spread, of_hot_key).drop(*drop)
               .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
        inside = rows.join(few, cond & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")
    outside = df.join(hot, _matching(keys), "left_anti").join(side, cond, how)
    return inside.unionByName(outside)


def join_known(df: DataFrame, side: DataFrame, key: str, side_key: str) -> DataFrame:
    """Left join on a key of any type, in which rows without a key match nothing. They are spread by their content, through
    a second column of the join that is 0 for all rows with a key and on the other side."""
    content = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salted = df.withColumn("_spread", F.when(F.col(key).isNull(), F.xxhash64(*content)).otherwise(F.lit(0).cast("long")))
    known = side.withColumn("_zero", F.col(side_key).isNull().cast("long"))      # no literal, which would not be a join key
    return salted.join(known, (F.col(key) == F.col(side_key)) & (F.col("_spread") == F.col("_zero")), "left").drop("_spread", "_zero")


def join_back(df: DataFrame, agg: DataFrame, keys: str | Sequence[str], how: str = "inner",
              heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Joins a per-key aggregate to the rows it came from, missing keys included."""
    keys = key_list(keys)
    renamed = agg.withColumnsRenamed({k: f"_agg_{k}" for k in keys})
    joined = lookup_join(df, renamed, {k: f"_agg_{k}" for k in keys}, how, null_safe=True, heavy=heavy)
    return joined.drop(*[f"_agg_{k}" for k in keys])


# ---- cutting them ----------------------------------------------------------


def hot_cells(df: DataFrame, entity: str | Sequence[str], order: Sequence[str],
              heavy: DataFrame | None | str = AUTO) -> list[DataFrame]:
    """The groups that are cut, as one small literal table; none without such groups."""
    groups = oversized(df, key_list(entity)) if isinstance(heavy, str) else heavy
    return [] if groups is None else [groups]


def with_cells(df: DataFrame, keys: list[str], order: list[str], levels: Sequence[DataFrame]) -> DataFrame:
    """Adds ``_cell``, a list that sorts like the order columns; empty for groups that are not cut.

    Rows of groups that are cut go through an exchange by ranges of (group, order columns), whose bounds Spark samples:
    a cell is what one partition gets of one group, about half of ``maxGroupRows`` however the values are
    spread, and finding it costs a row the same few comparisons whatever the number of cells. Rows equal in all of these columns share a
    cell. The rows are written with their cells (``session_stages``), so all users of the cells see the same ones even if
    a lost executor makes Spark compute a part again. Cells steer balance only, never results.
    """
    none = F.array().cast("array<bigint>")
    if not levels:
        return df.withColumn("_cell", none)
    groups = levels[0]
    parts = groups.agg(F.sum(F.ceil(F.col("_hot_count") / group_limit(df)))).first()[0] * CELLS_PER_TASK_SHARE
    by = [F.col(c).asc_nulls_last() for c in [*keys, *key_list(order)]]
    rows = df.join(F.broadcast(groups), _matching(keys), "left_semi").repartitionByRange(int(parts), *by)
    cut = session_stages(df.sparkSession).keep(rows.withColumn("_cell", F.array(F.spark_partition_id().cast("bigint"))), "cells")
    others = df.join(F.broadcast(groups), _matching(keys), "left_anti").withColumn("_cell", none)
    return cut.unionByName(others)


def join_cells(df: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds a per-cell table keyed ``_hot_<key>`` and ``_hot__cell``; its size is bounded by the number of cells."""
    path = [*keys, "_cell"]
    return df.join(F.broadcast(ledger), _matching(path), "left").drop(*[f"_hot_{k}" for k in path])
