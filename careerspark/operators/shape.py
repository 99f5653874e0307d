"""Column order, rounding of many columns, complete grids of categories, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import round_half_up
from .skew import join_back


def select_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position, counted from 0."""
    return df.select(*[df.columns[i] for i in positions])


def drop_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    gone = {df.columns[i] for i in positions}
    return df.select(*[c for c in df.columns if c not in gone])


def column_range(df: DataFrame, spec: str | Sequence[str]) -> list[str]:
    """``'A:D'`` is every column from A to D; otherwise the names themselves."""
    if not isinstance(spec, str):
        return list(spec)
    if spec not in df.columns and ":" in spec:
        lo, hi = (df.columns.index(c) for c in spec.split(":", 1))
        return df.columns[lo:hi + 1]
    return [spec]


def relocate(df: DataFrame, cols: str | Sequence[str], after: str | None = None, before: str | None = None) -> DataFrame:
    """Moves columns after or before another one; to the front without an anchor."""
    if after is not None and before is not None:
        raise ValueError("give after or before, not both")
    moved = column_range(df, cols)
    anchor = after or before
    if anchor in moved:
        raise ValueError(f"{anchor} cannot be its own anchor")
    rest = [c for c in df.columns if c not in moved]
    at = 0 if anchor is None else rest.index(anchor) + (after is not None)
    return df.select(*rest[:at], *moved, *rest[at:])


def round_cols(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    return df.withColumns({c: round_half_up(c, digits) for c in cols})


def level_grid(df: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the given levels: a literal table, its size is the product of the list lengths."""
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in levels])
    return df.sparkSession.createDataFrame(list(product(*levels.values())), schema)


def complete_grid(df: DataFrame, levels: Mapping[str, Sequence], fill: Mapping[str, object]) -> DataFrame:
    """Adds the missing combinations of category levels, with fill values.

    Combinations outside the level lists, missing categories included, are kept as they are.
    """
    full = level_grid(df, levels).join(df, list(levels), "full")
    return full.select(df.columns).fillna(dict(fill))


def share(df: DataFrame, n: str, out: str = "share", by: Sequence[str] | None = None) -> DataFrame:
    """Share of the grand total, or of the total of a group.

    ``df`` is a table of counts, so its groups are short. Totals are aggregated and joined back (one row, or one row
    per group) rather than gathered in one window.
    """
    if not by:
        total = df.select(F.sum(n)).scalar()
        return df.withColumn(out, F.try_divide(F.col(n).cast("double"), total.cast("double")))
    totals = df.groupBy(*by).agg(F.sum(n).alias("_total"))
    return join_back(df, totals, list(by), heavy=None).withColumn(
        out, F.try_divide(F.col(n).cast("double"), F.col("_total").cast("double"))).drop("_total")
