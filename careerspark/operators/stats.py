"""Correlation, least-squares lines with confidence bands, exact quantiles and kernel densities, all per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.student_t import p_value, t_quantile
from ..sources.stages import session_stages
from .sequence import annotate
from .skew import AUTO, join_back

# ---- correlation and lines -------------------------------------------------


def _pairs(df: DataFrame, x: str, y: str, by: Sequence[str], where: Column | None = None) -> DataFrame:
    kept = df if where is None else df.filter(where)
    return kept.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``(n, r, r2, t, p)``: correlation of complete pairs and its two-sided test against 0."""
    fit = _pairs(df, x, y, by, where).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("r"))
    dof = F.col("n") - 2
    exact = F.abs(F.col("r")) >= 1.0
    t = F.col("r") * F.sqrt(F.try_divide(dof.cast("double"), 1.0 - F.col("r") * F.col("r")))
    return (fit.withColumn("r2", F.col("r") * F.col("r"))
            .withColumn("t", F.when((dof > 0) & ~exact, t))
            .withColumn("p", F.when((dof > 0) & exact, F.lit(0.0)).otherwise(p_value(F.col("t"), dof.cast("double"))))
            .select(*by, "n", "r", "r2", "t", "p"))


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``(n, slope, intercept, r2)`` of the least-squares line."""
    return _pairs(df, x, y, by, where).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"))


def ols_band(df: DataFrame, x: str, y: str, by: Sequence[str] = (), grid: int = 80, level: float = 0.95,
             where: Column | None = None) -> DataFrame:
    """``(x, fit, lower, upper)``: the line and the confidence band of its mean, on an even grid over the data."""
    fit = _pairs(df, x, y, by, where).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"),
        F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    residual = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    line = (fit.filter(F.col("n") > 2)
            .withColumns({"slope": slope, "s": F.sqrt(F.try_divide(residual, F.col("n") - 2.0)),
                          "tq": t_quantile(1.0 - level, F.col("n") - 2.0)}))
    at = line.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    at = at.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_j") / F.lit(float(grid - 1)))
    offset = F.col("x") - F.col("mx")
    at = at.withColumns({"fit": F.col("my") + F.col("slope") * offset,
                         "half": F.col("tq") * F.col("s") * F.sqrt(1.0 / F.col("n") + F.try_divide(offset * offset, F.col("sxx")))})
    return at.select(*by, F.col("_j").alias("point"), "x", "fit",
                     (F.col("fit") - F.col("half")).alias("lower"), (F.col("fit") + F.col("half")).alias("upper"))


def scatter(df: DataFrame, x: str, y: str, colour: str | None = None, key: str | None = None,
            where: Column | None = None) -> DataFrame:
    """One point per entity inside the thresholds."""
    kept = df if where is None else df.filter(where)
    return kept.select(*[c for c in (key, x, y, colour) if c]).filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def tail_share(df: DataFrame, x: str, cut: float, by: Sequence[str] = (), out: str = "tail_share") -> DataFrame:
    """Share of values at least ``cut`` away from 0."""
    return (df.filter(F.col(x).isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col(x)) >= cut).alias("n_tail"))
            .withColumn(out, ratio("n_tail", "n")))


# ---- quantiles -------------------------------------------------------------


def _grouped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Without group columns, all rows are one group with a constant key."""
    return df if by else df.withColumn("_all", F.lit(0))


def exact_quantiles(df: DataFrame, x: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, one column each.

    Equal values are counted before the shuffle; then the running count finds the wanted ranks. The running count
    cuts oversized groups into cells, so the whole table can be one group.
    """
    keys = list(by) or ["_all"]
    values = _grouped(df, by).filter(F.col(x).isNotNull())
    counts = values.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    return quantiles_of_counts(counts, probs, keys).select(*by, *probs)


def quantiles_of_counts(counts: DataFrame, probs: dict[str, float], keys: Sequence[str], heavy=AUTO) -> DataFrame:
    """As ``exact_quantiles``, from the number ``_k`` of rows of each value ``_x`` of a group."""
    ranked = annotate(counts, keys, ["_x"], running_sums={"_upto": "_k"}, group_sums={"_total": "_k"}, heavy=heavy)
    aggs, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        place = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(place)
        for tag, rank in (("lo", low), ("hi", F.ceil(place))):
            holds = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_k") <= rank)
            aggs.append(F.max(F.when(holds, F.col("_x"))).alias(f"_{tag}{i}"))
        aggs.append(F.max(place - low).alias(f"_f{i}"))
        outs.append((F.col(f"_lo{i}") * (1.0 - F.col(f"_f{i}")) + F.col(f"_hi{i}") * F.col(f"_f{i}")).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)


# ---- kernel densities ------------------------------------------------------

KERNEL_REACH = 39.0    # bandwidths; the Gaussian kernel is 0 in double precision beyond


def bandwidth(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Rule-of-thumb Gaussian bandwidth per group: ``0.9 * min(sd, IQR / 1.34) * n^(-1/5)``.

    A zero spread falls back to the standard deviation, then to the size of the value itself, then to 1.
    """
    keys = list(by) or ["_all"]
    return _bandwidth(_value_counts(df, x, by), keys).select(*by, "n", "bw")


def _value_counts(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """How often each value occurs in each group: one scan and one shuffle of counts; all else is read from the written table."""
    values = _grouped(df, by).select(*(list(by) or ["_all"]), F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    return session_stages(df.sparkSession).keep(values.groupBy(*values.columns).agg(F.count(F.lit(1)).alias("_k")), "values")


def _bandwidth(counts: DataFrame, keys: list[str]) -> DataFrame:
    sums = counts.groupBy(*keys).agg(F.sum("_k").alias("n"), (F.sum(F.col("_x") * F.col("_k")) / F.sum("_k")).alias("_mean"), F.max(F.abs(F.col("_x"))).alias("_size"))
    away = F.col("_x") - F.col("_mean")
    basics = (join_back(counts, sums, keys, heavy=None).groupBy(*keys, "n", "_size").agg(F.sum(away * away * F.col("_k")).alias("_squares"))
              .withColumn("_sd", F.sqrt(F.try_divide(F.col("_squares"), F.col("n").cast("double") - 1.0))))
    both = join_back(basics, quantiles_of_counts(counts, {"_q1": 0.25, "_q3": 0.75}, keys), keys, heavy=None)
    spread = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    spread = (F.when(spread > 0, spread).when(F.col("_sd") > 0, F.col("_sd"))
              .when(F.col("_size") > 0, F.col("_size")).otherwise(F.lit(1.0)))
    return both.select(*keys, "n", (F.lit(0.9) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def kde(df: DataFrame, x: str, by: Sequence[str] = (), limits: tuple[float, float] | None = None, n: int = 512,
        bw: float | None = None, steps: int = 32, errors: bool = False, grid: tuple[float, float] | None = None) -> DataFrame:
    """``(by, point, x, density)``: Gaussian kernel density per group on ``n`` points.

    Values outside ``limits`` are left out before anything is computed; without limits the grid spans the values
    of all groups, or ``grid``, outside which values still count. Equal values are counted first, in one pass over ``df``; then values are shared out between the two nearest
    positions, ``steps`` to a bandwidth of their group, so the kernel is evaluated per filled position and not per row, and far
    outliers do not make positions coarser. A position adds only to points at which its kernel is not zero in double
    precision. With ``errors``, the column error bounds how far a density can be from the sum over all values: sharing a
    value out replaces the kernel by a chord, which is at most 1 / (8 steps^2) of its height away from it.
    """
    keys = list(by) or ["_all"]
    counts = _value_counts(df if limits is None else df.filter(F.col(x).cast("double").between(*limits)), x, by)
    if grid or limits:
        lo, hi = (F.lit(float(edge)) for edge in grid or limits)
    else:
        lo, hi = counts.agg(F.min("_x")).scalar(), counts.agg(F.max("_x")).scalar()
    if bw is None:
        width = _bandwidth(counts, keys)
    else:
        width = counts.groupBy(*keys).agg(F.sum("_k").alias("n")).withColumn("bw", F.lit(float(bw)))
    width = width.withColumns({"_lo": lo, "_hi": hi})
    step, gap = F.col("bw") / F.lit(float(steps)), (F.col("_hi") - F.col("_lo")) / F.lit(float(n - 1))
    binned = (join_back(counts, width, keys, heavy=None).withColumn("_p", (F.col("_x") - F.col("_lo")) / step).withColumn("_b", F.floor("_p"))
              .groupBy(*keys, "n", "bw", "_lo", "_hi", "_b")
              .agg(F.sum("_k").alias("_c"), F.sum((F.col("_p") - F.col("_b")) * F.col("_k")).alias("_up")))
    at, reach = F.col("_b") * step, F.col("bw") * F.lit(KERNEL_REACH)
    first = F.greatest(F.lit(0.0), F.coalesce(F.ceil(F.try_divide(at - reach, gap)).cast("double"), F.lit(0.0)))
    last = F.least(F.lit(n - 1.0), F.coalesce(F.floor(F.try_divide(at + step + reach, gap)).cast("double"), F.lit(n - 1.0)))
    near = (binned.withColumns({"_first": first, "_last": last}).filter(F.col("_first") <= F.col("_last"))
            .withColumn("point", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_last").cast("int")))))
    place = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / F.lit(float(n - 1))

    def kernel(position: Column) -> Column:
        u = (place - (F.col("_lo") + position * step)) / F.col("bw")
        return F.exp(u * u * F.lit(-0.5))

    mass = (F.col("_c") - F.col("_up")) * kernel(F.col("_b")) + F.col("_up") * kernel(F.col("_b") + 1)
    area = F.col("n") * F.col("bw") * F.lit(math.sqrt(2.0 * math.pi))
    every = width.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bound = F.lit(1.0 / (8 * steps * steps)) / (F.col("bw") * F.lit(math.sqrt(2.0 * math.pi)))
    parts = near.select(*keys, "point", place.alias("x"), (mass / area).alias("_d"), bound.alias("_e")).unionByName(
        every.select(*keys, "point", place.alias("x"), F.lit(0.0).alias("_d"), bound.alias("_e")))
    out = parts.groupBy(*by, "point").agg(F.max("x").alias("x"), F.sum("_d").alias("density"), F.max("_e").alias("error"))
    return out if errors else out.drop("error")


def kernel_sums(df: DataFrame, x: str, points: DataFrame, by: Sequence[str], bw: DataFrame) -> DataFrame:
    """The exact Gaussian kernel sum at given points, for checks: every distinct value of a group meets every point of it.
    ``points`` has the group, point and x; ``bw`` the group, n and bw. Returns the group, point and exact."""
    counts = _value_counts(df, x, by)
    keys = list(by) or ["_all"]
    grid = _grouped(points, by).groupBy(*keys).agg(F.collect_list(F.struct("point", "x")).alias("_points"))
    met = join_back(join_back(counts, _grouped(bw, by).select(*keys, "n", "bw"), keys, heavy=None), grid, keys, heavy=None)
    u = (F.col("_at.x") - F.col("_x")) / F.col("bw")
    each = met.withColumn("_at", F.explode("_points")).withColumn("_d", F.col("_k") * F.exp(u * u * F.lit(-0.5)) / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2.0 * math.pi))))
    return each.groupBy(*by, F.col("_at.point").alias("point")).agg(F.sum("_d").alias("exact"))
