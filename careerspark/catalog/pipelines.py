"""The plans of the analysis end to end, on the order tables: rankings, the two-milestone summary, data checks, ordered lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import RANK_LEVELS
from ..functions.scalars import year_date
from ..operators.classify import level_order, rank_group
from ..operators.resolve import Correction
from ..plans import checks, rankings, reports
from .base import CAREERS, customer_careers, query, rounded_sql, table
from .resolution import LISTS, yearly_lists

# ---- rankings --------------------------------------------------------------

ID_BY_NAME = {f"Customer {i:09d}": f"X{i}" for i in range(0, 200, 5)}
RULES = (Correction({"PROSPECT_RANK": 100, "POSITION_1": 1.0}, drop_row=True),
         Correction({"PROSPECT_RANK": 99}, {"ID": None, "TEAM": "Nobody"}))


def _people(spark, folder):
    """Customers as people. Some nations are moved to later years, after the play log, some to the eighties."""
    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("_k")).agg(F.min(F.col("o_orderdate").cast("date")).alias("_day"))
    moved = F.when(F.col("c_nationkey") >= 20, F.date_add("_day", 9000)).when(
        F.col("c_nationkey").between(13, 15), F.date_sub("_day", 2500)).otherwise(F.col("_day"))
    return table(spark, folder, "customer").join(first, F.col("c_custkey") == F.col("_k"), "left").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("PLAYERID"), F.lit("Customer").alias("NICKNAME"),
        F.substring("c_name", 10, 20).alias("LAST"), moved.alias("PLAY_DEBUT"), "c_nationkey", "c_mktsegment")


@query(f"""WITH {LISTS}, day AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY o_custkey),
people AS (SELECT 'C' || c_custkey AS pid, replace(c_name, '#', ' ') AS full_name, c_nationkey, c_mktsegment,
    CASE WHEN c_nationkey >= 20 THEN d + 9000 WHEN c_nationkey BETWEEN 13 AND 15 THEN d - 2500 ELSE d END AS debut
  FROM customer LEFT JOIN day ON c_custkey = o_custkey),
given AS (SELECT replace(name, '#', ' ') AS name, 'Team ' || position AS team, year, rank, position, 'C' || id AS id FROM lists),
raw AS (SELECT name, team, year, rank, position, coalesce(id, pid) AS id FROM given
  LEFT JOIN (SELECT * FROM people WHERE c_nationkey <= 12 OR debut > DATE '2021-01-01') ON name = full_name),
named AS (SELECT CASE WHEN id IS NULL THEN coalesce(full_name, name) ELSE name END AS name, team, year, rank, position, id
  FROM raw LEFT JOIN (SELECT * FROM people WHERE c_mktsegment = 'BUILDING') ON name = upper(full_name)),
late AS (SELECT name, team, year, rank, position, coalesce(id, CASE WHEN contains('{" ".join(f"<{n}>" for n in ID_BY_NAME)}', '<' || name || '>')
    THEN 'X' || CAST(substr(name, 10) AS BIGINT) END, pid) AS id
  FROM named LEFT JOIN (SELECT * FROM people WHERE debut > DATE '1987-01-01') ON name = full_name),
fixed AS (SELECT DISTINCT name, CASE WHEN rank = 99 THEN 'Nobody' ELSE team END AS team, year, rank, position, CASE WHEN rank <> 99 THEN id END AS id
  FROM late WHERE NOT (rank = 100 AND position = 1))
SELECT name AS "PLAYER_NAME", team AS "TEAM", year AS "YEAR", rank AS "PROSPECT_RANK", id AS "ID", debut AS "PLAY_DEBUT",
  date_diff('day', debut, year) / 7.0 AS "RANK_DEBUT_DATEDIFF_WKS"
FROM fixed LEFT JOIN (SELECT * FROM people WHERE debut > DATE '1987-01-01') ON id = pid""")
def ranking_pipeline(spark, folder):
    """Lists with misspelt names through the whole cascade, IDs by name, corrections, debuts and gaps."""
    people = _people(spark, folder)
    name = F.concat_ws(" ", "NICKNAME", "LAST")
    listed = yearly_lists(spark, folder).select(
        F.replace("name", F.lit("#"), F.lit(" ")).alias("PLAYER_NAME"), F.concat(F.lit("TEAM "), F.col("position").cast("string")).alias("TEAM"),
        F.year("year").alias("YEAR"), F.col("rank").alias("PROSPECT_RANK"), F.concat(F.lit("C"), F.col("id").cast("string")).alias("ID"),
        F.col("position").cast("double").alias("POSITION_1"), F.lit(None).cast("string").alias("MLB_DEBUT"))
    batters = people.filter("c_nationkey < 8").select(name.alias("BAT_NAME"), F.col("PLAYERID").alias("BAT_ID"))
    pitchers = people.filter("c_nationkey BETWEEN 8 AND 12").select(name.alias("PIT_NAME"), F.col("PLAYERID").alias("PIT_ID"))
    aliases = people.filter("c_mktsegment = 'BUILDING'").select(F.upper(name).alias("name"), name.alias("canonical_name"))
    out = rankings.resolved_rankings(listed, people, batters, pitchers, aliases, ID_BY_NAME, RULES)
    return out.select("PLAYER_NAME", "TEAM", "YEAR", "PROSPECT_RANK", "ID", "PLAY_DEBUT", "RANK_DEBUT_DATEDIFF_WKS")


@query(f"""WITH {LISTS} SELECT name, year, rank, row_number() OVER (ORDER BY name, year, rank) AS place,
CASE WHEN rank <= 25 THEN 5 WHEN rank <= 50 THEN 4 WHEN rank <= 75 THEN 3 ELSE 2 END AS group_place FROM lists""")
def ordered_lists(spark, folder):
    """Lists by name, then year, and the place of the rank group with its levels reversed. A list has 100 rows a year."""
    lists = yearly_lists(spark, folder)
    place = F.row_number().over(Window.orderBy("name", "year", "rank"))
    return lists.select("name", "year", "rank", place.alias("place"),
                        level_order(rank_group("rank"), tuple(reversed(RANK_LEVELS))).alias("group_place"))


# ---- reports ---------------------------------------------------------------

CUSTOMERS = reports.Role("o_custkey", "o_custkey", "debut", "career", "total", reports.Milestone("first_10", "post_10", "first_10_grade", "post_10_grade", "diff_10", 20),
                         reports.Milestone("first_40", "post_40", "first_40_grade", "post_40_grade", "diff_40", 40), 20, 40, True, None, 50)
PARTS = ("first_10", "post_10", "first_40", "post_40")


def _half_sql(name: str, cut: int, total: int) -> str:
    first, post = (rounded_sql(f"avg(floor({c}_{cut} * 1024) / 1024.0)", 3) for c in ("first", "post"))
    return f"""{name} AS (SELECT rank_group, {first} AS {name}_first, {post} AS {name}_post, count(*) AS n_{name} FROM careers
  WHERE total >= {total} AND debut < DATE '2011-01-01' GROUP BY rank_group)"""


@query(f"""WITH {CAREERS}, {_half_sql("early", 10, 20)}, {_half_sql("late", 40, 40)}
SELECT rank_group AS "PROSPECT_RANK_GROUP", early_first, early_post, {rounded_sql("early_post - early_first", 3)} AS early_difference, n_early,
  late_first, late_post, {rounded_sql("late_post - late_first", 3)} AS late_difference, n_late, floor(CAST(n_late AS DOUBLE) / n_early * 100.0 + 0.5) AS pct_remaining
FROM early LEFT JOIN late USING (rank_group)""")
def summary_table(spark, folder):
    """Means of values in 1024ths, which add up exactly, at two milestones."""
    bits = customer_careers(spark, folder).withColumns({c: F.floor(F.col(c) * 1024) / F.lit(1024.0) for c in PARTS})
    return reports.summary_table(bits.withColumnRenamed("rank_group", "PROSPECT_RANK_GROUP"), CUSTOMERS)


# ---- checks ----------------------------------------------------------------


@query("""WITH w AS (SELECT year(l_shipdate) AS y, min(CASE WHEN l_discount > 0 THEN l_discount END) AS low, max(l_discount) AS high, max(l_tax) AS tax
  FROM lineitem WHERE year(l_shipdate) BETWEEN 1990 AND 2020 GROUP BY year(l_shipdate)),
allowed AS (SELECT 0 AS hit, min(low) AS allowed_low, max(high) AS allowed_high FROM w
  UNION ALL SELECT 1, min(high), max(high) FROM w UNION ALL SELECT 2, min(tax), max(tax) FROM w
  UNION ALL SELECT 3, min(CASE WHEN y % 2 = 0 THEN low ELSE high END), max(CASE WHEN y % 2 = 0 THEN low ELSE high END) FROM w
  UNION ALL SELECT 4, min(low), max(low) FROM w),
seen AS (SELECT l_linenumber % 5 AS hit, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem WHERE l_discount <> 0 GROUP BY ALL)
SELECT seen.hit AS "HIT_VAL", lo AS "min_EVENT_WOBA", hi AS "max_EVENT_WOBA", allowed_low, allowed_high
FROM seen JOIN allowed ON seen.hit = allowed.hit WHERE lo < allowed_low OR hi > allowed_high""")
def measure_violations(spark, folder):
    """Discounts as the measure, the line number as the code; yearly extremes as published weights."""
    lines = table(spark, folder, "lineitem")
    plays = lines.select((F.col("l_linenumber") % 5).alias("HIT_VAL"), F.col("l_discount").alias("EVENT_WOBA"))
    yearly = lines.groupBy(F.year("l_shipdate").alias("y")).agg(
        F.min(F.when(F.col("l_discount") > 0, F.col("l_discount"))).alias("wBB"), F.max("l_discount").alias("w1B"), F.max("l_tax").alias("w2B"))
    weights = yearly.select(year_date("y").alias("Season"), "wBB", F.col("w1B").alias("wHBP"), "w1B", "w2B",
                            F.when(F.col("y") % 2 == 0, F.col("wBB")).otherwise(F.col("w1B")).alias("w3B"), F.col("wBB").alias("wHR"))
    return checks.measure_violations(plays, weights)
