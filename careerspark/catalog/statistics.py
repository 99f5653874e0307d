"""Correlation, lines and bands, densities, tail shares."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from ..operators import stats
from .base import CAREERS, careers_query, customer_careers, query, rounded_sql, saved, six, table

WHERE_SQL = "total >= 20 AND first_10 IS NOT NULL AND post_10 IS NOT NULL"

# Two-sided tail of Student's t by Simpson's rule over the angle, as a table function of (angle, dof).
SIMPSON = """(list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * exp((dof - 1.0) * ln(cos({a} + (least(pi() / 2, sqrt({a} * {a} + 80.0 / greatest(dof - 1.0, 1e-9))) - {a}) / 2000.0 * i)))))
  * (least(pi() / 2, sqrt({a} * {a} + 80.0 / greatest(dof - 1.0, 1e-9))) - {a}) / 2000.0 / 3.0)"""


def _careers(spark, folder):
    return customer_careers(spark, folder).filter(F.col("total") >= 20)


FIT = f"""fit AS (SELECT ranked, count(*) AS n, corr(post_10, first_10) AS r FROM careers WHERE {WHERE_SQL} GROUP BY ranked),
tested AS (SELECT *, r * r AS r2, CAST(n - 2 AS DOUBLE) AS dof, r * sqrt((n - 2) / (1.0 - r * r)) AS t FROM fit),
angles AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a FROM tested)"""


@query(f"""WITH {CAREERS}, {FIT} SELECT ranked, n, {rounded_sql("r", 6)} AS r, {rounded_sql("r2", 6)} AS r2, {rounded_sql("t", 6)} AS t,
{rounded_sql(f"{SIMPSON.format(a='a')} / {SIMPSON.format(a='0.0')}", 6)} AS p FROM angles""")
def pearson(spark, folder):
    return six(stats.pearson(_careers(spark, folder), "first_10", "post_10", ["ranked"]), "r", "r2", "t", "p")


@query(careers_query(f"""SELECT ranked, count(*) AS n, {rounded_sql("regr_slope(post_10, first_10)", 6)} AS slope,
{rounded_sql("regr_intercept(post_10, first_10)", 6)} AS intercept, {rounded_sql("regr_r2(post_10, first_10)", 6)} AS r2
FROM careers WHERE {WHERE_SQL} GROUP BY ranked"""))
def ols(spark, folder):
    return six(stats.ols(_careers(spark, folder), "first_10", "post_10", ["ranked"]), "slope", "intercept", "r2")


BAND = f"""WITH RECURSIVE {CAREERS}, s AS (SELECT ranked, CAST(count(*) AS DOUBLE) AS n, count(*) - 2.0 AS dof, avg(first_10) AS mx, avg(post_10) AS my,
    regr_sxx(post_10, first_10) AS sxx, regr_syy(post_10, first_10) AS syy, regr_sxy(post_10, first_10) AS sxy,
    min(first_10) AS lo_x, max(first_10) AS hi_x FROM careers WHERE {WHERE_SQL} GROUP BY ranked HAVING count(*) > 2),
whole AS (SELECT ranked, CAST(dof AS DOUBLE) AS dof, {SIMPSON.format(a='0.0')} * 0.05 AS target FROM s),
search AS (SELECT ranked, dof, target, CAST(0.0 AS DOUBLE) AS lo, pi() / 2 AS hi, 0 AS i FROM whole
  UNION ALL SELECT ranked, dof, target, CASE WHEN {SIMPSON.format(a='((lo + hi) / 2)')} > target THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {SIMPSON.format(a='((lo + hi) / 2)')} > target THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM search WHERE i < 50),
q AS (SELECT ranked, tan((lo + hi) / 2) * sqrt(dof) AS tq FROM search WHERE i = 50),
g AS (SELECT s.*, tq, point, lo_x + (hi_x - lo_x) * point / 79.0 AS x, sqrt(greatest(syy - sxy / sxx * sxy, 0.0) / (n - 2.0)) AS se
      FROM s JOIN q ON s.ranked = q.ranked CROSS JOIN (SELECT unnest(range(0, 80)) AS point)),
b AS (SELECT *, my + sxy / sxx * (x - mx) AS fit, tq * se * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx) AS half FROM g)"""


@query(f"""{BAND} SELECT ranked, CAST(point AS INTEGER) AS point, {rounded_sql("x", 6)} AS x, {rounded_sql("fit", 6)} AS fit,
{rounded_sql("fit - half", 6)} AS lower, {rounded_sql("fit + half", 6)} AS upper FROM b""")
def ols_band(spark, folder):
    """The t quantile of the SQL side is found by bisection in a recursive query."""
    return six(stats.ols_band(_careers(spark, folder), "first_10", "post_10", ["ranked"]), "x", "fit", "lower", "upper")


@query(careers_query(f"SELECT o_custkey, first_10, post_10, rank_group FROM careers WHERE {WHERE_SQL}"))
def scatter(spark, folder):
    return stats.scatter(customer_careers(spark, folder), "first_10", "post_10", "rank_group", "o_custkey", F.col("total") >= 20)


@query(careers_query("""SELECT ranked, count(*) AS n, count(CASE WHEN abs(diff_10) >= 0.1 THEN 1 END) AS n_tail,
CAST(count(CASE WHEN abs(diff_10) >= 0.1 THEN 1 END) AS DOUBLE) / count(*) AS tail_share FROM careers WHERE diff_10 IS NOT NULL GROUP BY ranked"""))
def tail_share(spark, folder):
    return stats.tail_share(customer_careers(spark, folder), "diff_10", 0.1, ["ranked"])


def kde_sql(value: str, by: str, where: str, limits: str, n: int = 512, steps: int = 32) -> str:
    """Rule-of-thumb bandwidth, linear binning by bandwidths and Gaussian kernel at all points, in the same steps."""
    return f"""WITH {CAREERS}, v AS (SELECT {by}, {value} AS x FROM careers WHERE {value} IS NOT NULL AND {where}),
lim AS ({limits}),
b AS (SELECT {by}, count(*) AS n, stddev_samp(x) AS sd, max(abs(x)) AS size, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v GROUP BY {by}),
w AS (SELECT {by}, n, 0.9 * (CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd WHEN size > 0 THEN size ELSE 1.0 END)
      * pow(n, -0.2) AS bw FROM b),
p AS (SELECT v.{by}, (x - lo) / (bw / {steps}.0) AS place FROM v JOIN w USING ({by}), lim),
bin AS (SELECT {by}, floor(place) AS b, count(*) AS c, sum(place - floor(place)) AS up FROM p GROUP BY {by}, floor(place)),
g AS (SELECT {by}, n, bw, b, c, up, lo, bw / {steps}.0 AS step, point, lo + (hi - lo) * point / {n - 1}.0 AS x
      FROM bin JOIN w USING ({by}), lim, (SELECT unnest(range(0, {n})) AS point))
SELECT {by}, CAST(point AS INTEGER) AS point, {rounded_sql("max(x)", 6)} AS x,
  {rounded_sql(f"sum(((c - up) * exp(-0.5 * pow((x - (lo + b * step)) / bw, 2)) + up * exp(-0.5 * pow((x - (lo + (b + 1) * step)) / bw, 2))) / (n * bw * {math.sqrt(2 * math.pi)!r}))", 6)} AS density
FROM g GROUP BY {by}, point"""


@query(kde_sql(value="diff_10", by="ranked", where="total >= 20 AND diff_10 BETWEEN -0.15 AND 0.15", limits="SELECT -0.15 AS lo, 0.15 AS hi"))
def kde(spark, folder):
    """Density of the before/after difference inside fixed limits."""
    careers = saved(_careers(spark, folder).select("ranked", "diff_10"), "differences")
    return six(stats.kde(careers, "diff_10", ["ranked"], limits=(-0.15, 0.15)), "x", "density")


@query(kde_sql(value="career", by="rank_group", where="total >= 20", limits="SELECT min(x) AS lo, max(x) AS hi FROM v"))
def kde_career(spark, folder):
    """Density of the career value per rank group, over the range of all groups."""
    careers = saved(_careers(spark, folder).select("rank_group", "career"), "careers")
    return six(stats.kde(careers, "career", ["rank_group"]), "x", "density")


FAR = 1e9       # one value far away from all others


@query(f"""WITH v AS (SELECT s_nationkey % 3 AS g, s_acctbal AS x FROM supplier UNION ALL SELECT 0, {FAR}),
b AS (SELECT g, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v GROUP BY g),
w AS (SELECT g, n, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM b),
p AS (SELECT unnest(range(0, 64)) AS point),
i AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier),
e AS (SELECT w.g, point, lo + (hi - lo) * point / 63.0 AS place, sum(exp(-0.5 * pow((lo + (hi - lo) * point / 63.0 - x) / bw, 2))) / (any_value(n) * any_value(bw) * {math.sqrt(2 * math.pi)!r}) AS exact
      FROM w JOIN v ON v.g = w.g, p, i GROUP BY w.g, point, lo, hi)
SELECT g, CAST(point AS INTEGER) AS point, {rounded_sql("place", 6)} AS place, {rounded_sql("exact * 1000000", 3)} AS exact, true AS within FROM e""")
def kde_within_error(spark, folder):
    """Densities of balances, with one value a hundred thousand times as large in a group, against the exact kernel sums: their
    distance is within the bound that they state."""
    balances = table(spark, folder, "supplier").select((F.col("s_nationkey") % 3).alias("g"), F.col("s_acctbal").alias("x"))
    values = saved(balances.unionByName(spark.createDataFrame([(0, FAR)], balances.schema)), "balances")
    edges = balances.agg(F.min("x"), F.max("x")).first()
    # The grid lies over the balances; the far value counts for the bandwidth, and is too far to add to any density.
    widths = stats.bandwidth(values, "x", ["g"])
    place = F.lit(edges[0]) + F.lit(edges[1] - edges[0]) * F.col("point") / F.lit(63.0)
    grid = widths.select("g", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("point")).withColumn("x", place)
    exact = stats.kernel_sums(values, "x", grid, ["g"], widths)
    near = stats.kde(values, "x", ["g"], n=64, errors=True, grid=(edges[0], edges[1]))
    met = near.join(exact, ["g", "point"]).withColumn("within", F.abs(F.col("density") - F.col("exact")) <= F.col("error"))
    return met.select("g", "point", round_half_up("x", 6).alias("place"), round_half_up(F.col("exact") * 1000000, 3).alias("exact"), "within")
