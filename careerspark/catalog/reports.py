"""Crosstabs, shares, before/after tables, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import GRADE_LEVELS, RANK_LEVELS, SIMPLE_FIRST_LEVELS, SIMPLE_POST_LEVELS
from ..functions.scalars import date_lit, mirrored, percent_label, trimmed_number
from ..operators import report, shape
from ..operators.classify import simple_grade
from ..operators.resolve import enrich
from .base import CAREERS, careers_query, customer_careers, query, rounded_sql, table


def _values(levels, name):
    return f"(SELECT unnest([{', '.join(repr(v) for v in levels)}]) AS {name})"


CELLS = {"rank_group": RANK_LEVELS, "first_10_grade": GRADE_LEVELS, "post_10_grade": GRADE_LEVELS}
COUNTS = """counts AS (SELECT rank_group, first_10_grade, post_10_grade, count(*) AS n FROM careers GROUP BY ALL),
grid AS (SELECT * FROM {0} CROSS JOIN {1} CROSS JOIN {2}),
ct AS (SELECT rank_group, first_10_grade, post_10_grade, coalesce(n, 0) AS n
       FROM grid FULL JOIN counts USING (rank_group, first_10_grade, post_10_grade))""".format(
    _values(RANK_LEVELS, "rank_group"), _values(GRADE_LEVELS, "first_10_grade"), _values(GRADE_LEVELS, "post_10_grade"))
TOTALS = COUNTS + """, totals AS (SELECT rank_group, CASE WHEN grouping(first_10_grade) = 1 THEN 'Total' ELSE first_10_grade END AS first_10_grade,
  CASE WHEN grouping(post_10_grade) = 1 THEN 'Total' ELSE post_10_grade END AS post_10_grade, CAST(sum(n) AS BIGINT) AS n
  FROM ct GROUP BY GROUPING SETS ((rank_group, first_10_grade, post_10_grade), (rank_group, first_10_grade), (rank_group, post_10_grade), (rank_group)))"""


def _ct(careers):
    return report.crosstab3(careers, "first_10_grade", "post_10_grade", "rank_group", CELLS)


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {CAREERS}, {ctes} {body}"


@query(with_ctes("two AS (SELECT career_grade, ranked, count(*) AS n FROM careers GROUP BY ALL)", "SELECT career_grade, ranked, n FROM two"))
def crosstab(spark, folder):
    return report.crosstab(customer_careers(spark, folder), "career_grade", "ranked")


@query(with_ctes(COUNTS, "SELECT rank_group, first_10_grade, post_10_grade, n FROM ct"))
def crosstab3(spark, folder):
    return _ct(customer_careers(spark, folder))


@query(with_ctes(TOTALS, "SELECT rank_group, first_10_grade, post_10_grade, n FROM totals"))
def crosstab_totals(spark, folder):
    return report.add_totals(_ct(customer_careers(spark, folder)), "first_10_grade", "post_10_grade", ["rank_group"])


PERCENT = """SELECT t.rank_group, t.first_10_grade, t.post_10_grade, t.n,
  CASE WHEN t.post_10_grade <> 'Total' AND r.n > 0 THEN CAST(t.n AS DOUBLE) / r.n END AS pct
  FROM totals t JOIN totals r ON t.rank_group = r.rank_group AND t.first_10_grade = r.first_10_grade AND r.post_10_grade = 'Total'"""


@query(with_ctes(TOTALS, PERCENT))
def crosstab_row_percent(spark, folder):
    totals = report.add_totals(_ct(customer_careers(spark, folder)), "first_10_grade", "post_10_grade", ["rank_group"])
    return report.row_percent(totals, "first_10_grade", "post_10_grade", ["rank_group"])


@query(with_ctes(TOTALS, f"SELECT first_10_grade, post_10_grade, n, pct FROM ({PERCENT}) WHERE rank_group = 'Unranked'"))
def crosstab_slice(spark, folder):
    return report.slice_of(crosstab_row_percent(spark, folder), "rank_group", "Unranked")


@query(with_ctes(COUNTS, "SELECT rank_group, first_10_grade, " + ", ".join(
    f"CAST(sum(CASE WHEN post_10_grade = '{g}' THEN n END) AS BIGINT) AS \"{g}\"" for g in GRADE_LEVELS) + " FROM ct GROUP BY ALL"))
def crosstab_wide(spark, folder):
    return report.wide(_ct(customer_careers(spark, folder)), "first_10_grade", "post_10_grade", GRADE_LEVELS, slice_cols=["rank_group"])


def _simple_counts(spark, folder, *extra):
    simple = customer_careers(spark, folder).withColumns({
        "first": simple_grade("first_10_grade"), "post": simple_grade("post_10_grade", "Bad")})
    return simple.groupBy("first", "post", *extra).agg(F.count(F.lit(1)).alias("n"))


SIMPLE = {"first": SIMPLE_FIRST_LEVELS, "post": SIMPLE_POST_LEVELS}
SIMPLE_SQL = """s AS (SELECT rank_group, CASE WHEN first_10_grade IN ('Elite', 'Great', 'Good') THEN 'Good' WHEN first_10_grade IN ('Average', 'DNQ')
    THEN first_10_grade ELSE 'Bad' END AS first, CASE WHEN post_10_grade IN ('Elite', 'Great', 'Good') THEN 'Good'
    WHEN post_10_grade = 'Average' THEN 'Average' WHEN post_10_grade IS NOT NULL THEN 'Bad' END AS post FROM careers)"""
FIRST, POST, RANKS = _values(SIMPLE_FIRST_LEVELS, "first"), _values(SIMPLE_POST_LEVELS, "post"), _values(RANK_LEVELS, "rank_group")
GRID2 = f"""{SIMPLE_SQL}, k AS (SELECT first, post, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT first, post, coalesce(n, 0) AS n FROM (SELECT * FROM {FIRST} CROSS JOIN {POST}) FULL JOIN k USING (first, post))"""
GRID3 = f"""{SIMPLE_SQL}, k AS (SELECT rank_group, first, post, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT rank_group, first, post, coalesce(n, 0) AS n FROM (SELECT * FROM {FIRST} CROSS JOIN {POST} CROSS JOIN {RANKS})
      FULL JOIN k USING (rank_group, first, post))"""


@query(with_ctes(GRID2, "SELECT first, post, n FROM f"))
def complete_grid(spark, folder):
    return shape.complete_grid(_simple_counts(spark, folder), SIMPLE, {"n": 0})


@query(with_ctes(GRID2, """SELECT first, post, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share,
CASE WHEN CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) > 0.035
     THEN CAST(CAST(floor(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS label FROM f"""))
def grid_share(spark, folder):
    full = shape.complete_grid(_simple_counts(spark, folder), SIMPLE, {"n": 0})
    return shape.share(full, "n").withColumn("label", percent_label("share", 0.035))


@query(with_ctes(GRID3, "SELECT rank_group, first, post, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY rank_group) AS DOUBLE) AS share FROM f"))
def grid_share_by_group(spark, folder):
    full = shape.complete_grid(_simple_counts(spark, folder, "rank_group"), {**SIMPLE, "rank_group": RANK_LEVELS}, {"n": 0})
    return shape.share(full, "n", by=["rank_group"])


@query(with_ctes("""k AS (SELECT rank_group, ranked_last, count(*) AS n FROM (SELECT rank_group,
    CASE WHEN last_day > DATE '2001-06-01' THEN 'Yes' ELSE 'No' END AS ranked_last FROM careers) GROUP BY GROUPING SETS ((rank_group, ranked_last), (rank_group), (ranked_last), ())),
t AS (SELECT coalesce(rank_group, 'Total') AS rank_group, coalesce(ranked_last, 'Total') AS active, n FROM k)""",
"""SELECT t.rank_group, t.active, t.n, CAST(t.n AS DOUBLE) / r.n AS pct,
CAST(CAST(floor(CAST(t.n AS DOUBLE) / r.n * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '% (' || CAST(t.n AS VARCHAR) || ')' AS label
FROM t JOIN t r ON t.rank_group = r.rank_group AND r.active = 'Total'"""))
def rate_table(spark, folder):
    labelled = customer_careers(spark, folder).select(
        "rank_group", F.when(F.col("last_day") > date_lit("2001-06-01"), "Yes").otherwise("No").alias("active"))
    return report.rate_table(labelled, "rank_group", "active")


@query(careers_query(f"""SELECT rank_group, first_mean, post_mean, {rounded_sql("post_mean - first_mean", 3)} AS difference, n FROM (
SELECT rank_group, {rounded_sql("avg(first_bits) / 1024.0", 3)} AS first_mean, {rounded_sql("avg(post_bits) / 1024.0", 3)} AS post_mean, count(*) AS n FROM (
  SELECT rank_group, floor(first_10 * 1024) AS first_bits, floor(post_10 * 1024) AS post_bits FROM careers WHERE total >= 20) GROUP BY rank_group)"""))
def before_after_summary(spark, folder):
    """Means of the per-customer values in 1024ths, which add up exactly."""
    bits = customer_careers(spark, folder).withColumns({
        "first_bits": F.floor(F.col("first_10") * 1024) / F.lit(1024.0), "post_bits": F.floor(F.col("post_10") * 1024) / F.lit(1024.0)})
    return report.before_after_summary(bits, "rank_group", "first_bits", "post_bits", F.col("total") >= 20)


@query(careers_query(f"""SELECT rank_group, n_t1, n_t2, {rounded_sql("CAST(n_t2 AS DOUBLE) / n_t1", 2)} * 100.0 AS pct_remaining FROM (
SELECT rank_group, count(CASE WHEN total >= 20 THEN 1 END) AS n_t1, count(CASE WHEN total >= 40 THEN 1 END) AS n_t2 FROM careers GROUP BY rank_group) WHERE n_t1 > 0"""))
def retention(spark, folder):
    return report.retention(customer_careers(spark, folder), "rank_group", "total", 20, 40)


@query(careers_query("""SELECT rank_group, count(*) AS n, count(CASE WHEN career_grade IN ('Elite', 'Great', 'Good') THEN 1 END) AS n_reach,
CAST(count(CASE WHEN career_grade IN ('Elite', 'Great', 'Good') THEN 1 END) AS DOUBLE) / count(*) AS share FROM careers GROUP BY rank_group"""))
def band_share(spark, folder):
    return report.band_share(customer_careers(spark, folder), "rank_group", "career_grade", GRADE_LEVELS, "Good")


@query(careers_query("""SELECT rank_group, count(*) AS n, count(CASE WHEN post_10_grade IN ('Elite', 'Great', 'Good', 'Average') THEN 1 END) AS n_reach,
CAST(count(CASE WHEN post_10_grade IN ('Elite', 'Great', 'Good', 'Average') THEN 1 END) AS DOUBLE) / count(*) AS share
FROM careers WHERE first_10_grade = 'Awful' GROUP BY rank_group"""))
def transition_share(spark, folder):
    """Of the customers that began Awful, the share that became Average or better."""
    ct = report.crosstab3(customer_careers(spark, folder), "first_10_grade", "post_10_grade", "rank_group")
    return report.transition_share(ct, "rank_group", "first_10_grade", "post_10_grade", GRADE_LEVELS, "Awful", "Average")


def _best():
    return [F.col("career").desc_nulls_last(), F.col("o_custkey").asc_nulls_last()]


@query(careers_query("SELECT o_custkey, career, rank FROM careers WHERE ranked = 'N' AND total >= 20 ORDER BY career DESC, o_custkey LIMIT 100"))
def top_k(spark, folder):
    where = (F.col("ranked") == "N") & (F.col("total") >= 20)
    return report.top_k(customer_careers(spark, folder), _best(), 100, ["o_custkey", "career", "rank"], where)


@query(careers_query("""SELECT CAST(sum(total) AS BIGINT) AS total_events, median(CAST(rank AS DOUBLE)) AS median_rank, avg(rank) AS mean_rank
FROM (SELECT * FROM careers WHERE ranked = 'Y' ORDER BY career DESC, o_custkey LIMIT 50)"""))
def top_k_summary(spark, folder):
    return report.top_k_summary(customer_careers(spark, folder), _best(), 50, [
        F.sum("total").alias("total_events"), report.median("rank").alias("median_rank"), F.avg("rank").alias("mean_rank")],
        F.col("ranked") == "Y")


@query(careers_query("""SELECT o_custkey, total, first_10, post_10, diff_10 FROM careers WHERE post_10 IS NOT NULL AND total >= 20
ORDER BY diff_10, o_custkey LIMIT 20"""))
def risers(spark, folder):
    """Biggest falls in the measure, which is what improves when lower is better."""
    where = F.col("post_10").isNotNull() & (F.col("total") >= 20)
    return report.top_k(customer_careers(spark, folder), [F.col("diff_10").asc_nulls_last(), F.col("o_custkey")], 20,
                        ["o_custkey", "total", "first_10", "post_10", "diff_10"], where)


@query(careers_query("""SELECT career_grade, ranked, count(*) AS n, CASE WHEN ranked = 'Y' THEN -count(*) ELSE count(*) END AS signed_n
FROM careers GROUP BY career_grade, ranked"""))
def pyramid(spark, folder):
    ct = report.crosstab(customer_careers(spark, folder), "career_grade", "ranked")
    return ct.withColumn("signed_n", mirrored("n", F.col("ranked") == "Y"))


@query("""SELECT sum(l_quantity) AS l_quantity_sum, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum,
sum(l_quantity) / sum(l_linenumber) AS rate, sum(l_quantity) / sum(l_linenumber) * 50.0 AS per_50, sum(l_quantity) / sum(l_linenumber) * 200.0 AS per_200 FROM lineitem""")
def calibrate(spark, folder):
    return report.calibrate(table(spark, folder, "lineitem"), "l_quantity", "l_linenumber", {"per_50": 50, "per_200": 200})


@query(careers_query(f"""SELECT o_custkey, regexp_replace(printf('%.3f', {rounded_sql("career", 3)}), '^(-?)0\\.', '\\1.') AS career_text,
regexp_replace(printf('%.3f', {rounded_sql("diff_10", 3)}), '^(-?)0\\.', '\\1.') AS diff_text FROM careers"""))
def label_format(spark, folder):
    return customer_careers(spark, folder).select(
        "o_custkey", trimmed_number("career").alias("career_text"), trimmed_number("diff_10").alias("diff_text"))


@query(careers_query("SELECT o_custkey, career, avg_price FROM careers LEFT JOIN (SELECT o_custkey AS k, avg(CAST(floor(o_totalprice) AS BIGINT)) AS avg_price FROM orders GROUP BY o_custkey) ON o_custkey = k"))
def enrich_summary(spark, folder):
    prices = table(spark, folder, "orders").groupBy("o_custkey").agg(F.avg(F.floor("o_totalprice")).alias("avg_price"))
    return enrich(customer_careers(spark, folder).select("o_custkey", "career"), prices, "o_custkey")


@query(careers_query("""SELECT o_custkey AS customer, rank AS list_rank, rank_group, career AS career_rate, first_10 AS first_rate FROM careers
WHERE debut < DATE '1996-01-01'"""))
def publish_players(spark, folder):
    return report.publish(customer_careers(spark, folder), {
        "o_custkey": "customer", "rank": "list_rank", "rank_group": "rank_group", "career": "career_rate", "first_10": "first_rate"},
        "debut", "1996-01-01")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rounded_sql("l_extendedprice", 1)} AS l_extendedprice,
{rounded_sql("l_tax", 1)} AS l_tax, l_returnflag FROM lineitem""")
def shape_columns(spark, folder):
    """Columns by position, moved by name and range, several rounded at once."""
    lines = shape.select_at(table(spark, folder, "lineitem"), [0, 1, 2, 3, 5, 7, 8])
    moved = shape.relocate(shape.relocate(lines, "l_orderkey:l_partkey", after="l_returnflag"), "l_tax", before="l_suppkey")
    return shape.round_cols(moved, ["l_extendedprice", "l_tax"], 1)
