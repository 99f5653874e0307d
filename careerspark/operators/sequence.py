"""Ordered event histories: sequence numbers, running and whole-history means, milestones.

Numbering needs all events of one entity in order, and one entity may hold a large part of the log.
``annotate`` therefore looks for entities with more rows than one task should sort. Without any, a plain
window is planned. Those that exist are cut into cells by an exchange over ranges of the order columns: each cell is
ordered by a task of its own, and a small ledger of per-cell counts and sums carries the totals from cell to cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_col, max_of, mean_of, min_of, round_half_up, weeks_between, years_from_weeks
from .skew import AUTO, hot_cells, join_back, join_cells, key_list, lookup_join, with_cells

def _ordering(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in key_list(order)]


def _reverse(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in key_list(order)]


# ---- the annotated log -----------------------------------------------------

def annotate(
    df: DataFrame,
    entity: str | Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    size: str | None = None,
    running_sums: Mapping[str, str] | None = None,
    running_means: Mapping[str, str] | None = None,
    group_sums: Mapping[str, str] | None = None,
    group_means: Mapping[str, str] | None = None,
    heavy: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Adds order-dependent columns to every event in one pass over one partitioning.

    ``order`` must be a total order inside an entity, or numbers of tied rows are arbitrary. ``number`` counts
    1, 2, 3 ..; ``size`` is the number of events of the entity; the mappings are ``{new column: measure}``.
    Null measures are skipped. The search for oversized entities is one counting pass over ``df``; ``heavy`` takes
    the answer of ``oversized`` for a cheaper table, or None where sizes are known to be small.
    """
    keys = key_list(entity)
    running_sums, running_means = dict(running_sums or {}), dict(running_means or {})
    group_sums, group_means = dict(group_sums or {}), dict(group_means or {})
    measures = sorted({*running_sums.values(), *running_means.values(), *group_sums.values(), *group_means.values()})
    levels = hot_cells(df, keys, order, heavy)

    cut, source = ([], df) if not levels else (["_cell"], with_cells(df, keys, key_list(order), levels))
    upto = Window.partitionBy(*keys, *cut).orderBy(*_ordering(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, *cut)

    ordered = {}
    if number:
        ordered["_number"] = F.row_number().over(upto).cast("long")
    for i, m in enumerate(measures):
        if m in running_sums.values() or m in running_means.values():
            ordered[f"_rs{i}"] = F.sum(m).over(upto)
        if m in running_means.values():
            ordered[f"_rn{i}"] = F.count(m).over(upto)
    if size:
        ordered["_size"] = F.count(F.lit(1)).over(whole)
    for i, m in enumerate(measures):
        if m in group_sums.values() or m in group_means.values():
            ordered[f"_gs{i}"] = F.sum(m).over(whole)
        if m in group_means.values():
            ordered[f"_gn{i}"] = F.count(m).over(whole)
    out = source.withColumns(ordered)

    if levels:
        ledger = _ledger(source.filter(F.size("_cell") > 0), keys, measures)
        out = join_cells(out, ledger, keys)
        carried = {}
        for name in ordered:
            led = F.col(f"_led{name}")
            if name == "_number" or name.startswith("_r"):
                here = F.coalesce(F.col(name), F.when(led.isNotNull(), F.lit(0)))
                carried[name] = here + F.coalesce(led, F.lit(0))
            else:
                carried[name] = F.when(F.size("_cell") > 0, led).otherwise(F.col(name))
        out = out.withColumns(carried)

    final = {}
    if number:
        final[number] = F.col("_number")
    if size:
        final[size] = F.col("_size")
    at = {m: i for i, m in enumerate(measures)}
    for new, m in running_sums.items():
        final[new] = F.col(f"_rs{at[m]}")
    for new, m in running_means.items():
        final[new] = F.try_divide(F.col(f"_rs{at[m]}").cast("double"), F.col(f"_rn{at[m]}").cast("double"))
    for new, m in group_sums.items():
        final[new] = F.col(f"_gs{at[m]}")
    for new, m in group_means.items():
        final[new] = F.try_divide(F.col(f"_gs{at[m]}").cast("double"), F.col(f"_gn{at[m]}").cast("double"))
    kept = [c for c in df.columns if c not in final]
    return out.select(*[F.col(c) for c in kept], *[v.alias(k) for k, v in final.items()])


def _ledger(cells: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Per cell: what lies before it in its group, and the totals of the group.

    The rows are as many as the cells: a few for each task's share of the rows of oversized groups.
    """
    per_cell = cells.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(m).alias(f"_s{i}") for i, m in enumerate(measures)],
        *[F.count(m).alias(f"_n{i}") for i, m in enumerate(measures)])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.sum("_c").over(before).alias("_led_number"), F.sum("_c").over(group).alias("_led_size")]
    for i in range(len(measures)):
        cols += [F.sum(f"_s{i}").over(before).alias(f"_led_rs{i}"), F.sum(f"_n{i}").over(before).alias(f"_led_rn{i}"),
                 F.sum(f"_s{i}").over(group).alias(f"_led_gs{i}"), F.sum(f"_n{i}").over(group).alias(f"_led_gn{i}")]
    return per_cell.select(*[F.col(k).alias(f"_hot_{k}") for k in [*keys, "_cell"]], *cols)


def number_events(df: DataFrame, entity, order, out: str = "event_num",
                  heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Sequence number of each event of an entity."""
    return annotate(df, entity, order, number=out, heavy=heavy)


def running_mean(df: DataFrame, entity, order, measure: str, out: str = "running_mean") -> DataFrame:
    """Mean of the measure from the first event of the entity up to this one."""
    return annotate(df, entity, order, running_means={out: measure})


def group_total(df: DataFrame, entity, out: str = "group_total") -> DataFrame:
    """Number of rows of the entity, on each row.

    Counts are pre-aggregated and joined back; adaptive execution splits the join's partition of a large group, so
    no task has to hold a whole one and nothing is counted beforehand.
    """
    keys = key_list(entity)
    return join_back(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys, heavy=None)


def group_mean(df: DataFrame, entity, measure: str, out: str = "group_mean") -> DataFrame:
    """Mean of the measure over all rows of the entity, on each row."""
    keys = key_list(entity)
    return join_back(df, df.groupBy(*keys).agg(F.avg(measure).alias(out)), keys, heavy=None)


# ---- one row per entity ----------------------------------------------------

def entity_totals(df: DataFrame, entity, measure: str, total: str = "total", mean: str = "mean") -> DataFrame:
    """Events and mean measure per entity."""
    return df.groupBy(*key_list(entity)).agg(F.count(F.lit(1)).alias(total), F.avg(measure).alias(mean))


def latest_attributes(df: DataFrame, entity, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Attribute values on the last event of each entity."""
    keys = key_list(entity)
    last = F.max_by(F.struct(*cols), F.struct(*key_list(order))).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


def bucket_mean(measure: str | Column, seq: str, lo: int, hi: int | None) -> Column:
    """Mean of a measure over events ``lo .. hi``; an open end when ``hi`` is None."""
    inside = F.col(seq) >= lo if hi is None else F.col(seq).between(lo, hi)
    return F.avg(F.when(inside, as_col(measure)))


def milestone_means(df: DataFrame, entity, seq: str, columns: Mapping[str, tuple], extra: Sequence[Column] = ()) -> DataFrame:
    """Means over ranges of sequence numbers, all in one aggregate.

    ``columns`` is ``{new column: (measure, first number, last number or None)}``; ``extra`` takes further
    aggregates of the same pass.
    """
    return df.groupBy(*key_list(entity)).agg(
        *extra, *[bucket_mean(m, seq, lo, hi).alias(new) for new, (m, lo, hi) in columns.items()])


def bucket_sums(df: DataFrame, entity, seq: str, edges: Sequence[Column | int], measures: Sequence[str], extra: Mapping[str, tuple[Column, str]] = {}) -> DataFrame:
    """Sums between milestones, from which ``bucket_mean_of`` takes the mean over any run of them.

    ``edges`` are the last sequence numbers of the buckets but the open last one; they may depend on the row (roles with
    milestones of their own). A row is added to one bucket, whatever the number of means that are asked for. ``extra`` is
    ``{column: (aggregate, "sum", "min" or "max")}``: the second says how aggregates of buckets are put together.
    """
    keys = key_list(entity)
    bucket = sum(((F.col(seq) > e).cast("int") for e in edges), F.lit(0))
    parts = df.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(
        *[x for i, m in enumerate(measures) for x in (F.sum(m).cast("double").alias(f"_s{i}"), F.count(m).alias(f"_n{i}"))],
        *[agg.alias(f"_x{i}") for i, (agg, _) in enumerate(extra.values())])
    together = {"sum": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_bucket") == b, F.col(f"_{k}{i}"))).alias(f"_{m}_{k}{b}")
          for i, m in enumerate(measures) for b in range(len(edges) + 1) for k in "sn"],
        *[together[how](f"_x{i}").alias(name) for i, (name, (_, how)) in enumerate(extra.items())])


def bucket_mean_of(measure: str, first: int, last: int) -> Column:
    """Mean of a measure over buckets ``first`` to ``last`` of ``bucket_sums``; missing without values."""
    total, n = (sum((F.coalesce(F.col(f"_{measure}_{k}{b}"), F.lit(0)) for b in range(first, last + 1)), F.lit(0)) for k in "sn")
    return F.try_divide(total.cast("double"), n.cast("double"))


def split_columns(measure: str | Column, cuts: Sequence[int], first: str = "first_{}", post: str = "post_{}") -> dict:
    """Bucket list for the mean of the first N events and of all later ones, for several N."""
    out = {}
    for n in cuts:
        out[first.format(n)] = (measure, 1, n)
        out[post.format(n)] = (measure, n + 1, None)
    return out


def split_means(df: DataFrame, entity, seq: str, measure: str, cuts: Sequence[int],
                first: str = "first_{}", post: str = "post_{}") -> DataFrame:
    """First-N and after-N means for every cut, in one aggregate."""
    return milestone_means(df, entity, seq, split_columns(measure, cuts, first, post))


def split_diff(df: DataFrame, first: str, post: str, out: str, digits: int | None = 3) -> DataFrame:
    """After minus first on unrounded means, rounded at the end."""
    diff = F.col(post) - F.col(first)
    return df.withColumn(out, diff if digits is None else round_half_up(diff, digits))


def workload(df: DataFrame, entity, means: Mapping[str, str] | None = None, mins: Mapping[str, str] | None = None,
             null_policy: str = "skip") -> DataFrame:
    """Means and minima of workload fields per entity."""
    return df.groupBy(*key_list(entity)).agg(
        *[mean_of(c, null_policy).alias(new) for new, c in (means or {}).items()],
        *[min_of(c, null_policy).alias(new) for new, c in (mins or {}).items()])


# ---- group ends and extremes -----------------------------------------------

def tail_n(df: DataFrame, group, order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows of each group.

    Spark keeps at most ``n`` rows per group in each task before the shuffle, so a huge group stays small. It does so up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows; for more, groups are first cut into as many parts as there are
    shuffle partitions, by a hash of the order columns, and each part is limited by a task of its own.
    """
    keys, conf = key_list(group), df.sparkSession.conf
    rows, last = df, Window.partitionBy(*keys).orderBy(*_reverse(order))
    if n >= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        part = F.pmod(F.xxhash64(*key_list(order)), F.lit(int(conf.get("spark.sql.shuffle.partitions"))))
        of_part = Window.partitionBy(*keys, "_part").orderBy(*_reverse(order))
        rows = df.withColumn("_part", part).withColumn("_rn", F.row_number().over(of_part)).filter(F.col("_rn") <= n).drop("_rn", "_part")
    return rows.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n).drop("_rn")


def tail_matches(df: DataFrame, group, order: Sequence[str], n: int, predicate: Column,
                 where: Column | None = None) -> DataFrame:
    """Last ``n`` rows of the groups in which all of these rows match the predicate.

    Rows outside ``where`` do not count as part of the group. Groups with fewer than ``n`` rows never qualify.
    """
    keys = key_list(group)
    ends = tail_n(df if where is None else df.filter(where), keys, order, n)
    hits = F.count_if(predicate).over(Window.partitionBy(*keys))
    return ends.withColumn("_hits", hits).filter(F.col("_hits") == n).drop("_hits")


def _extreme_rows(df: DataFrame, group, col: str, pick, null_policy: str, heavy: DataFrame | None | str) -> DataFrame:
    keys = key_list(group)
    if heavy is None:   # groups are short: one window, and ``df`` is read once
        w = Window.partitionBy(*keys)
        best = df.withColumns({"_best": pick(col, "skip").over(w), "_lacking": F.count_if(F.col(col).isNull()).over(w)})
        kept = F.col(col) == F.col("_best")
        return best.filter(kept & (F.col("_lacking") == 0) if null_policy == "propagate" else kept).drop("_best", "_lacking")
    best = df.groupBy(*keys).agg(pick(col, null_policy).alias("_best")).filter(F.col("_best").isNotNull())
    renamed = best.withColumnsRenamed({k: f"_agg_{k}" for k in keys})
    return lookup_join(df, renamed, {k: f"_agg_{k}" for k in keys}, "left_semi", null_safe=True,
                       heavy=heavy, where=F.col(col) == F.col("_best"))


def arg_max_rows(df: DataFrame, group, col: str, null_policy: str = "propagate",
                 heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Rows that hold the largest value of their group, ties kept.

    Under ``propagate`` a group with a missing value has no maximum and is left out.
    """
    return _extreme_rows(df, group, col, max_of, null_policy, heavy)


def arg_min_rows(df: DataFrame, group, col: str, null_policy: str = "propagate",
                 heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Rows that hold the smallest value of their group, ties kept."""
    return _extreme_rows(df, group, col, min_of, null_policy, heavy)


# ---- cohorts and ages ------------------------------------------------------

def cohort(df: DataFrame, col: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """Rows whose date lies strictly after and strictly before the limits; missing dates drop out."""
    cond = F.lit(True)
    if after is not None:
        cond = cond & (F.col(col) > F.lit(after).cast("date"))
    if before is not None:
        cond = cond & (F.col(col) < F.lit(before).cast("date"))
    return df.filter(cond & F.col(col).isNotNull())


def age_at(df: DataFrame, event_date: str, birth: str, weeks: str = "age_wks", years: str = "age_yrs") -> DataFrame:
    """Age at the event in weeks, and in years of 52 weeks."""
    age = weeks_between(event_date, birth)
    return df.withColumns({weeks: age, years: years_from_weeks(age)})
