"""Roles, classes, rank groups, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import GRADE_LEVELS
from ..operators import classify
from ..operators.classify import grade, inverted_grade
from ..operators.resolve import attach_person
from ..operators.sequence import entity_totals, milestone_means, split_columns
from .base import (LINE_KEY, LOG, RANK_GROUP_SQL, balance_ranking, careers_query, customer_careers, grade_sql,
                   heavy_customers, heavy_suppliers, line_log, measure, numbered_sql, query, ranking_sql, rounded_sql,
                   saved, simple_sql, supplier_numbered, table)

# Both roles keyed alike: returned lines by supplier, all lines by customer.
ROLES = f"""{LOG}, a AS (SELECT l_suppkey AS k, count(*) AS a_total, avg(x) AS a_mean FROM log WHERE l_returnflag = 'R' GROUP BY l_suppkey),
b AS (SELECT o_custkey AS k, count(*) AS b_total, avg(x) AS b_mean FROM log GROUP BY o_custkey),
roles AS (SELECT k, a_total, a_mean, b_total, b_mean, ratio,
  CASE WHEN b_total IS NULL THEN 'Batter' WHEN a_total IS NULL THEN 'Pitcher' WHEN ratio < 0.8 THEN 'Pitcher'
       WHEN ratio <= 4.25 THEN 'Two-Way' WHEN ratio > 4.25 THEN 'Batter' END AS role
  FROM (SELECT coalesce(a.k, b.k) AS k, a_total, a_mean, b_total, b_mean,
          {rounded_sql("CAST(a_total AS DOUBLE) / CAST(b_total AS DOUBLE)", 2)} AS ratio FROM a FULL JOIN b ON a.k = b.k))"""


def _roles(spark, folder):
    """Supplier totals need no join: every line has its order."""
    returned = table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R").withColumn("x", measure())
    a = entity_totals(returned, "l_suppkey", "x", "a_total", "a_mean").withColumnRenamed("l_suppkey", "k")
    b = entity_totals(line_log(spark, folder), "o_custkey", "x", "b_total", "b_mean").withColumnRenamed("o_custkey", "k")
    return classify.role_ratio(a, b, "k", "a_total", "b_total")


@query(f"WITH {ROLES} SELECT k, a_total, a_mean, b_total, b_mean, ratio, role FROM roles")
def role_ratio(spark, folder):
    return _roles(spark, folder)


@query(f"""WITH {ROLES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, s.role = 'Pitcher' AS supplier_out
FROM log JOIN roles s ON l_suppkey = s.k JOIN roles c ON o_custkey = c.k
WHERE s.a_total >= 1 AND c.b_total >= 1 AND NOT c.role = 'Batter'""")
def role_flags(spark, folder):
    """Lines flagged by the role of their supplier, without customers that are out of their role."""
    log, roles = line_log(spark, folder), saved(_roles(spark, folder), "roles")
    s_flags = classify.role_flags(roles, "k", "a_total", "supplier_out", "Pitcher")
    c_flags = classify.role_flags(roles, "k", "b_total", "customer_out", "Batter")
    flagged = classify.attach_flags(log, s_flags, "l_suppkey", "k", heavy_suppliers(spark, folder))
    flagged = classify.attach_flags(flagged, c_flags, "o_custkey", "k", heavy_customers(log, folder))
    return classify.drop_out_of_role(flagged, "customer_out").select(*LINE_KEY, "o_custkey", "supplier_out")


@query(f"""WITH {LOG} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, s_name AS S_s_name, s_nationkey AS S_s_nationkey,
c_name AS C_c_name, c_mktsegment AS C_c_mktsegment FROM log LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey""")
def attach_person_two_roles(spark, folder):
    log = line_log(spark, folder).select(*LINE_KEY, "o_custkey")
    out = attach_person(log, table(spark, folder, "supplier"), "l_suppkey", "s_suppkey", "S_", ["s_name", "s_nationkey"],
                        heavy_suppliers(spark, folder))
    return attach_person(out, table(spark, folder, "customer"), "o_custkey", "c_custkey", "C_", ["c_name", "c_mktsegment"],
                         heavy_customers(log, folder))


# ---- supplier grades: the flagship -----------------------------------------

SUPPLIER_GATES = {"first_150": 150, "first_600": 600, "post_150": 600, "post_600": 620}
SUPPLIERS = f"""{LOG}, {numbered_sql("l_suppkey")}, m AS (SELECT l_suppkey, count(*) AS total, avg(x) AS career,
  avg(CASE WHEN num <= 150 THEN x END) AS first_150, avg(CASE WHEN num > 150 THEN x END) AS post_150,
  avg(CASE WHEN num <= 600 THEN x END) AS first_600, avg(CASE WHEN num > 600 THEN x END) AS post_600
  FROM numbered GROUP BY l_suppkey),
g AS (SELECT *, {", ".join(f"{grade_sql(c, 'total', n)} AS {c}_grade" for c, n in SUPPLIER_GATES.items())} FROM m)"""


def supplier_grades(spark, folder):
    means = milestone_means(supplier_numbered(spark, folder), "l_suppkey", "num", split_columns("x", [150, 600]), [
        F.count(F.lit(1)).alias("total"), F.avg("x").alias("career")])
    return means.withColumns({f"{c}_grade": grade(c, total="total", min_total=n) for c, n in SUPPLIER_GATES.items()})


@query(f"""WITH {SUPPLIERS} SELECT l_suppkey, total, career, first_150, post_150, first_600, post_600,
first_150_grade, post_150_grade, first_600_grade, post_600_grade FROM g""")
def grades_first_post(spark, folder):
    return supplier_grades(spark, folder)


@query(f"""WITH {SUPPLIERS} SELECT first_600_grade, post_600_grade, count(*) AS n FROM g GROUP BY first_600_grade, post_600_grade""")
def graded_careers(spark, folder):
    """Suppliers by grade before and after 600 lines."""
    return supplier_grades(spark, folder).groupBy("first_600_grade", "post_600_grade").agg(F.count(F.lit(1)).alias("n"))


@query(careers_query(f"""SELECT o_custkey, {simple_sql("first_10_grade", "DNQ")} AS first_simple, {simple_sql("post_10_grade", "Bad")} AS post_simple FROM careers"""))
def simple_grades(spark, folder):
    return customer_careers(spark, folder).select(
        "o_custkey", classify.simple_grade("first_10_grade").alias("first_simple"),
        classify.simple_grade("post_10_grade", "Bad").alias("post_simple"))


@query(careers_query("SELECT o_custkey, total, career, career_grade FROM careers"))
def career_grade(spark, folder):
    return customer_careers(spark, folder).select("o_custkey", "total", "career", "career_grade")


@query(careers_query(f"""SELECT o_custkey, {grade_sql("career", "total", 40, inverted=True)} AS inverted,
CASE WHEN rank IS NOT NULL THEN {grade_sql("post_10", "total", 40, inverted=True)} END AS ranked_only FROM careers"""))
def inverted_grades(spark, folder):
    """Lower is better; the second grade is for ranked customers only."""
    return customer_careers(spark, folder).select(
        "o_custkey", inverted_grade("career", total="total", min_total=40).alias("inverted"),
        inverted_grade("post_10", total="total", min_total=40, scope=F.col("rank").isNotNull()).alias("ranked_only"))


SCORES = "CASE {0} " + " ".join(f"WHEN '{g}' THEN {8 - i}" for i, g in enumerate(GRADE_LEVELS)) + " END"
LEVELS = "CASE {0} " + " ".join(f"WHEN '{g}' THEN {i + 1}" for i, g in enumerate(GRADE_LEVELS)) + " END"


@query(careers_query(f"""SELECT o_custkey, {SCORES.format("first_10_grade")} AS first_score, {SCORES.format("post_10_grade")} AS post_score,
{LEVELS.format("career_grade")} AS career_level FROM careers"""))
def grade_score(spark, folder):
    return customer_careers(spark, folder).select(
        "o_custkey", classify.grade_score("first_10_grade").alias("first_score"),
        classify.grade_score("post_10_grade").alias("post_score"),
        classify.level_order("career_grade", GRADE_LEVELS).alias("career_level"))


@query("""SELECT o_custkey, last_day, CASE WHEN last_day > DATE '2001-07-01' THEN 'ACTIVE' WHEN last_day < DATE '2001-07-01' THEN 'INACTIVE' END AS status
FROM (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY o_custkey)""")
def status_at(spark, folder):
    last = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("last_day"))
    return classify.status_at(last, "last_day", "2001-07-01")


@query("""SELECT o_custkey, avg_lines, min_line, mean_line, CASE WHEN avg_lines >= 27 THEN 'STARTER' WHEN avg_lines <= 22 THEN 'RELIEVER'
WHEN min_line > 1 THEN 'RELIEVER' WHEN mean_line > 4.1 THEN 'RELIEVER' ELSE 'OTHER' END AS class
FROM (SELECT o_custkey, avg(l_quantity) AS avg_lines, min(l_linenumber) AS min_line, avg(l_linenumber) AS mean_line
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)""")
def workload_class(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    work = lines.groupBy("o_custkey").agg(F.avg("l_quantity").alias("avg_lines"), F.min("l_linenumber").alias("min_line"),
                                          F.avg("l_linenumber").alias("mean_line"))
    return classify.workload_class(work, "avg_lines", "min_line", "mean_line", "class", starter=27, reliever=22, late=4.1)


RANKED_SUPPLIERS = ranking_sql("supplier", "s_suppkey", "s_acctbal")


def _ranked_suppliers(spark, folder):
    supplier = table(spark, folder, "supplier")
    latest = balance_ranking(supplier, "s_suppkey", "s_acctbal")
    return supplier.join(latest, F.col("s_suppkey") == F.col("ranked_key"), "left")


@query(f"WITH {RANKED_SUPPLIERS} SELECT s_suppkey, rank, {RANK_GROUP_SQL} AS rank_group FROM supplier LEFT JOIN ranking ON s_suppkey = ranked_key")
def rank_group(spark, folder):
    return _ranked_suppliers(spark, folder).select("s_suppkey", "rank", classify.rank_group("rank").alias("rank_group"))


@query(f"""WITH {RANKED_SUPPLIERS} SELECT s_suppkey, CASE WHEN rank BETWEEN 1 AND 100 THEN 'Y' WHEN rank IS NULL THEN 'N' END AS ranked
FROM supplier LEFT JOIN ranking ON s_suppkey = ranked_key""")
def ranked_flag(spark, folder):
    return _ranked_suppliers(spark, folder).select("s_suppkey", classify.ranked_flag("rank").alias("ranked"))
