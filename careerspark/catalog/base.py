"""Registry, and the order tables seen as event histories.

Suppliers and customers are the two roles of each order line; the measure is the discount in percent over 16, which
doubles hold exactly, so sums do not depend on the order in which rows are added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GRADES
from ..functions.scalars import round_half_up
from ..operators.classify import grade, rank_group, ranked_flag
from ..operators.resolve import attach_ranking
from ..operators.sequence import milestone_means, number_events, split_columns, split_diff
from ..operators.skew import oversized
from ..sources.stages import session_stages


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(run):
        REGISTRY[name or run.__name__] = Query(run, sql)
        return run
    return register


def saved(df: DataFrame, name: str) -> DataFrame:
    """A summary written once, for queries that read it several times; the same summary is not written again."""
    return session_stages(df.sparkSession).keep(df, name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- the log ---------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ORDER = ["d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def measure() -> Column:
    return F.floor(F.col("l_discount") * 100 + 0.5) / F.lit(16.0)


def line_log(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with order date ``d``, both roles and the measure ``x``.

    A plain join of two stored tables: keys are many and short, and adaptive execution splits the partition of an
    order with very many lines, so counting lines per order first would cost more than it saves.
    """
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", measure().alias("x"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def supplier_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The log with the number ``num`` of each line of a supplier; group sizes are counted before the join."""
    return number_events(line_log(spark, folder), "l_suppkey", ORDER, "num", heavy=heavy_suppliers(spark, folder))


def heavy_suppliers(spark: SparkSession, folder: str) -> DataFrame | None:
    lines = table(spark, folder, "lineitem")
    return oversized(lines, "l_suppkey", rows_of=lines)


def heavy_customers(log: DataFrame, folder: str) -> DataFrame | None:
    return oversized(log, "o_custkey", rows_of=table(log.sparkSession, folder, "lineitem"))


LOG = """log AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_returnflag,
         l_linestatus, floor(l_discount * 100 + 0.5) / 16.0 AS x, o_custkey, CAST(o_orderdate AS DATE) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ORDER_SQL = "d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


def numbered_sql(key: str, name: str = "numbered") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ORDER_SQL}) AS num FROM log)"


# ---- rankings of one list --------------------------------------------------


def balance_ranking(accounts: DataFrame, key: str, balance: str) -> DataFrame:
    """Ranks 1 to 100 by balance; at most 100 rows leave each task."""
    w = Window.partitionBy("_list").orderBy(F.col(balance).desc(), F.col(key))
    listed = accounts.withColumn("_list", F.lit(1))
    return listed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 100).select(F.col(key).alias("ranked_key"), "rank")


def ranking_sql(source: str, key: str, balance: str) -> str:
    return f"""ranking AS (SELECT {key} AS ranked_key, rn AS rank FROM (
      SELECT {key}, row_number() OVER (ORDER BY {balance} DESC, {key}) AS rn FROM {source})
      WHERE rn <= 100)"""


# ---- customer careers ------------------------------------------------------

GATES = {"first_10": 10, "post_10": 40, "first_40": 40, "post_40": 60, "career": 40}


def customer_careers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: totals, means before and after 10 and 40 lines, rank, grades."""
    log = line_log(spark, folder)
    log = number_events(log, "o_custkey", ORDER, "num", heavy_customers(log, folder))
    out = milestone_means(log, "o_custkey", "num", split_columns("x", [10, 40]), [
        F.count(F.lit(1)).alias("total"), F.avg("x").alias("career"), F.min("d").alias("debut"), F.max("d").alias("last_day")])
    latest = balance_ranking(table(spark, folder, "customer"), "c_custkey", "c_acctbal")
    out = attach_ranking(out, latest, "o_custkey", "ranked_key", "rank")
    out = split_diff(split_diff(out, "first_10", "post_10", "diff_10"), "first_40", "post_40", "diff_40")
    return out.withColumns({
        "rank_group": rank_group("rank"), "ranked": ranked_flag("rank"),
        **{f"{c}_grade": grade(c, total="total", min_total=g) for c, g in GATES.items()}})


def grade_sql(value: str, total: str | None = None, gate: int | None = None, inverted: bool = False) -> str:
    """CASE expression of a grade, with the bands written as rates."""
    milli = f"floor(({value}) * 1000.0 + 0.5)"
    g = list(GRADES) if not inverted else list(reversed(GRADES))
    branches = [f"WHEN {milli} >= {b} THEN '{name}'" for b, name in zip((400, 370, 340, 320, 310, 291), g)]
    gate_branch = f"WHEN {total} < {gate} THEN 'DNQ' " if gate is not None else ""
    return f"CASE {gate_branch}WHEN ({value}) IS NULL THEN NULL {' '.join(branches)} ELSE '{g[-1]}' END"


def simple_sql(g: str, dnq: str) -> str:
    """CASE expression of a simple grade; ``dnq`` is what not qualifying counts as."""
    return f"""CASE WHEN {g} IN ('Elite', 'Great', 'Good') THEN 'Good' WHEN {g} = 'Average' THEN 'Average'
      WHEN {g} IN ('Below Average', 'Poor', 'Awful') THEN 'Bad' WHEN {g} = 'DNQ' THEN '{dnq}' END"""


RANK_GROUP_SQL = """CASE WHEN rank IS NULL THEN 'Unranked' WHEN rank BETWEEN 1 AND 25 THEN '1 - 25'
  WHEN rank BETWEEN 26 AND 50 THEN '26 - 50' WHEN rank BETWEEN 51 AND 75 THEN '51 - 75'
  WHEN rank BETWEEN 76 AND 100 THEN '76 - 100' END"""


def rounded_sql(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}.0"
    return f"floor(({expr}) * {scale} + 0.5) / {scale}"


CAREERS = f"""{LOG}, {numbered_sql("o_custkey")}, {ranking_sql("customer", "c_custkey", "c_acctbal")},
means AS (
  SELECT o_custkey, count(*) AS total, avg(x) AS career, min(d) AS debut, max(d) AS last_day,
         avg(CASE WHEN num <= 10 THEN x END) AS first_10, avg(CASE WHEN num > 10 THEN x END) AS post_10,
         avg(CASE WHEN num <= 40 THEN x END) AS first_40, avg(CASE WHEN num > 40 THEN x END) AS post_40
  FROM numbered GROUP BY o_custkey),
careers AS (
  SELECT means.*, rank, {RANK_GROUP_SQL} AS rank_group,
         CASE WHEN rank BETWEEN 1 AND 100 THEN 'Y' WHEN rank IS NULL THEN 'N' END AS ranked,
         {rounded_sql("post_10 - first_10", 3)} AS diff_10, {rounded_sql("post_40 - first_40", 3)} AS diff_40,
         {grade_sql("first_10", "total", 10)} AS first_10_grade, {grade_sql("post_10", "total", 40)} AS post_10_grade,
         {grade_sql("first_40", "total", 40)} AS first_40_grade, {grade_sql("post_40", "total", 60)} AS post_40_grade,
         {grade_sql("career", "total", 40)} AS career_grade
  FROM means LEFT JOIN ranking ON o_custkey = ranked_key)"""


def careers_query(body: str) -> str:
    return f"WITH {CAREERS} {body}"


def six(df: DataFrame, *cols: str) -> DataFrame:
    """Results of floating-point sums, rounded so that the order of additions does not show."""
    return df.withColumns({c: round_half_up(c, 6) for c in cols})
