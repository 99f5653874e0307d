"""Report tables over per-entity summaries: crosstabs, before/after, retention, top-k, published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (DEBUT_RATE_TODAY, MIN_GAP_WEEKS, PUBLISH_BEFORE, RANK_LEVELS)
from ..functions.scalars import as_col, date_lit, ratio, round_half_up, weeks_between
from .classify import level_order, rank_group
from .resolve import latest_ranking
from .sequence import arg_min_rows, cohort
from .shape import complete_grid
from .skew import AUTO

TOTAL = "Total"

# ---- one-row results -------------------------------------------------------


def calibrate(df: DataFrame, num: str, den: str, units: Mapping[str, float], rate: str = "rate") -> DataFrame:
    """Ratio of two global sums, and that ratio scaled to some units; one row."""
    sums = df.agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"))
    value = ratio("_num", "_den")
    return sums.select(F.col("_num").alias(f"{num}_sum"), F.col("_den").alias(f"{den}_sum"), value.alias(rate),
                       *[(value * float(u)).alias(name) for name, u in units.items()])


def occurrence_rate(total: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """How many distinct groups there are, how many of them qualify, and "1 in N"; one row."""
    n_hits = hits.agg(F.countDistinct(key)).scalar()
    return total.agg(F.countDistinct(key).alias("n_total")).select(
        "n_total", n_hits.alias("n_hits"),
        (ratio(n_hits, "n_total") * 100.0).alias("pct"), ratio("n_total", n_hits).alias("one_in"))


def distinct_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


# ---- crosstabs in long form ------------------------------------------------


def crosstab(df: DataFrame, row: str, col: str, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Two-way counts ``(row, col, n)``; with ``levels`` empty cells appear as 0."""
    ct = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return ct if levels is None else complete_grid(ct, levels, {"n": 0})


def crosstab3(df: DataFrame, row: str, col: str, slice_col: str,
              levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Three-way counts ``(slice, row, col, n)``; with ``levels`` every cell of every slice appears."""
    ct = df.groupBy(slice_col, row, col).agg(F.count(F.lit(1)).alias("n"))
    if levels is None:
        return ct
    ordered = {c: levels[c] for c in (slice_col, row, col)}
    return complete_grid(ct, ordered, {"n": 0}).select(slice_col, row, col, "n")


def slice_of(ct: DataFrame, slice_col: str, value: str) -> DataFrame:
    return ct.filter(F.col(slice_col) == value).drop(slice_col)


def add_totals(ct: DataFrame, row: str, col: str, slice_cols: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Adds a Total row and a Total column to every slice, by grouping sets over the counts."""
    keys = [*slice_cols, row, col]
    sets = [keys, [*slice_cols, row], [*slice_cols, col], list(slice_cols)]
    summed = ct.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(
        F.sum(n).alias("_n"), F.grouping(row).alias("_gr"), F.grouping(col).alias("_gc"))
    label = {c: F.when(F.col(g) == 1, TOTAL).otherwise(F.col(c)) for c, g in ((row, "_gr"), (col, "_gc"))}
    return summed.select(*slice_cols, label[row].alias(row), label[col].alias(col), F.col("_n").alias(n))


def row_percent(ct: DataFrame, row: str, col: str, slice_cols: Sequence[str] = (), n: str = "n",
                out: str = "pct") -> DataFrame:
    """Share of each cell in its row, over the level columns; the Total column keeps only its count.

    A row without any count has no shares.
    """
    cells = Window.partitionBy(*slice_cols, row)   # as many rows as there are column levels
    is_level = F.col(col).isNull() | (F.col(col) != TOTAL)
    total = F.sum(F.when(is_level, F.col(n))).over(cells)
    return ct.withColumn(out, F.when(is_level, ratio(n, total)))


def rate_table(df: DataFrame, row: str, col: str, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Two-way table with totals, row percentages and a text label "46% (12)"."""
    ct = add_totals(crosstab(df, row, col, levels), row, col)
    total = F.max(F.when(F.col(col) == TOTAL, F.col("n"))).over(Window.partitionBy(row))
    pct = F.concat(F.floor(F.col("pct") * 100.0 + 0.5).cast("string"), F.lit("%"))
    count = F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return ct.withColumn("pct", ratio("n", total)).select(
        row, col, "n", "pct", F.concat(F.coalesce(pct, F.lit("-")), count).alias("label"))


def wide(ct: DataFrame, row: str, col: str, col_levels: Sequence[str], value: str = "n",
         slice_cols: Sequence[str] = ()) -> DataFrame:
    """Long form to one column per level; the level list is given, so no extra job looks for it."""
    return ct.groupBy(*slice_cols, row).pivot(col, list(col_levels)).agg(F.first(value))


# ---- before and after ------------------------------------------------------


def before_after_summary(df: DataFrame, by: str | Sequence[str], first: str, post: str, where: Column | None = None,
                         names: tuple[str, str, str, str] = ("first_mean", "post_mean", "difference", "n"),
                         digits: int = 3) -> DataFrame:
    """Group means before and after, their difference after rounding, and the number of entities."""
    keys = [by] if isinstance(by, str) else list(by)
    f_name, p_name, d_name, n_name = names
    return (
        (df if where is None else df.filter(where))
        .groupBy(*keys)
        .agg(round_half_up(F.avg(first), digits).alias(f_name), round_half_up(F.avg(post), digits).alias(p_name),
             F.count(F.lit(1)).alias(n_name))
        .select(*keys, f_name, p_name, round_half_up(F.col(p_name) - F.col(f_name), digits).alias(d_name), n_name)
    )


def retention(df: DataFrame, by: str, total: str, t1: int, t2: int, out: str = "pct_remaining") -> DataFrame:
    """Of the entities with at least ``t1`` events, how many reach ``t2``; whole percent."""
    counts = df.groupBy(by).agg(F.count_if(F.col(total) >= t1).alias("n_t1"), F.count_if(F.col(total) >= t2).alias("n_t2"))
    return counts.filter(F.col("n_t1") > 0).withColumn(out, round_half_up(ratio("n_t2", "n_t1"), 2) * 100.0)


def band_share(df: DataFrame, by: str, band: str, levels: Sequence[str], at_least: str, out: str = "share") -> DataFrame:
    """Share of each group whose band is at least as good as the given one; levels are best first."""
    reach = level_order(band, levels) <= list(levels).index(at_least) + 1
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(reach).alias("n_reach")).withColumn(
        out, ratio("n_reach", "n"))


def transition_share(ct: DataFrame, slice_col: str, row: str, col: str, levels: Sequence[str], from_band: str,
                     at_least: str, out: str = "share") -> DataFrame:
    """Per slice: of those that began in one band, the share that ended in a given band or a better one."""
    reach = level_order(col, levels) <= list(levels).index(at_least) + 1
    return (ct.filter(F.col(row) == from_band).groupBy(slice_col)
            .agg(F.sum("n").alias("n"), F.sum(F.when(reach, F.col("n")).otherwise(0)).alias("n_reach"))
            .withColumn(out, ratio("n_reach", "n")))


# ---- top k -----------------------------------------------------------------


def top_k(df: DataFrame, order: Sequence[Column], k: int, cols: Sequence[str] | None = None,
          where: Column | None = None) -> DataFrame:
    """First ``k`` rows of an order; end the order with a key, so that ties do not change the result."""
    top = (df if where is None else df.filter(where)).orderBy(*order).limit(k)
    return top if cols is None else top.select(*cols)


def top_k_summary(df: DataFrame, order: Sequence[Column], k: int, aggs: Sequence[Column], where: Column | None = None) -> DataFrame:
    """Aggregates over the first ``k`` rows; one row."""
    return top_k(df, order, k, where=where).agg(*aggs)


def median(c: str | Column) -> Column:
    """Exact interpolated median, for aggregates over at most ``k`` rows."""
    return F.percentile(as_col(c), F.lit(0.5))


# ---- rankings --------------------------------------------------------------


def last_listed(rankings: DataFrame, name: str, year: str, today: str = DEBUT_RATE_TODAY,
                heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Most recent ranking of each name: the smallest distance to a fixed day; ties kept."""
    gap = rankings.withColumn("_weeks", weeks_between(date_lit(today), year))
    return arg_min_rows(gap, name, "_weeks", heavy=heavy).drop("_weeks")


def _none_or_auto(heavy: DataFrame | None | str) -> None | str:
    """Two steps on different keys share only the knowledge that nothing is oversized."""
    return None if heavy is None else AUTO


def debut_rate(rankings: DataFrame, *, name: str, entity: str, year: str, rank: str, debut: str, gap: str,
               role: Column | None = None, before: str = PUBLISH_BEFORE, today: str = DEBUT_RATE_TODAY,
               min_gap: float = MIN_GAP_WEEKS, heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """How many ranked names reached a debut, by rank group, with totals and row percentages.

    Names without an entity enter with their last listed row, entities with the ranking in force at debut.
    """
    never = last_listed(rankings.filter(F.col(entity).isNull()), name, year, today, _none_or_auto(heavy))
    debuted = latest_ranking(rankings, entity, gap, min_gap, _none_or_auto(heavy))
    every = never.unionByName(debuted, allowMissingColumns=True)
    listed = every.filter(F.col(year) < date_lit(before))
    if role is not None:
        listed = listed.filter(role)
    labelled = listed.select(rank_group(rank).alias("rank_group"),
                             F.when(F.col(debut).isNotNull(), "Yes").otherwise("No").alias("debuted"))
    return rate_table(labelled, "rank_group", "debuted", {"rank_group": RANK_LEVELS[:-1], "debuted": ("Yes", "No")})


# ---- published tables ------------------------------------------------------


def publish(df: DataFrame, columns: Mapping[str, str] | Sequence[str], debut: str, before: str = PUBLISH_BEFORE) -> DataFrame:
    """Final column list, renamed and ordered, for entities that began before a date."""
    pairs = columns.items() if isinstance(columns, Mapping) else [(c, c) for c in columns]
    return cohort(df, debut, before=before).select(*[F.col(src).alias(dst) for src, dst in pairs])
