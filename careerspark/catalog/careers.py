"""The published player tables, with suppliers as batters and the customers' nations as pitchers.

Lines that were not accepted do not count for the measure; the line number stands for the inning.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BATTER_CUTS, PITCHER_CUTS
from ..functions.scalars import date_lit
from ..plans import players
from .base import (LINE_KEY, LOG, ORDER_SQL, RANK_GROUP_SQL, balance_ranking, grade_sql, line_log, query, ranking_sql,
                   rounded_sql, saved, simple_sql, table)

ORDER = ["DATE", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def _plays(spark, folder):
    """The play log as a stored table, which is what the plans expect: they read it several times."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    log = line_log(spark, folder).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    supplier, nation = F.col("l_suppkey").cast("string"), F.col("c_nationkey").cast("string")
    plays = log.select(
        *LINE_KEY, "l_shipdate", "l_extendedprice", F.col("d").alias("DATE"), F.concat(F.lit("S"), supplier).alias("BAT_ID"),
        F.concat(F.lit("Supplier "), supplier).alias("BAT_NAME"), F.concat(F.lit("N"), nation).alias("PIT_ID"),
        F.concat(F.lit("Nation "), nation).alias("PIT_NAME"), F.col("x").alias("EVENT_WOBA"), (F.col("l_returnflag") != "A").alias("WOBA_APP"),
        F.col("l_linenumber").alias("INNING"),
        F.when((F.col("c_nationkey") % 5 > 0) | (F.col("l_quantity") < 50), (F.col("l_quantity") * 3).cast("int")).alias("PITCH_COUNT_FINAL"),
        F.when((F.col("c_nationkey") % 3 > 0) | (F.col("l_quantity") > 5), F.col("l_linenumber")).alias("PIT_REST"))
    return saved(plays, "plays")


def _people(plays):
    """Debut and last day of everyone in either role."""
    both = plays.select("DATE", F.explode(F.array("BAT_ID", "PIT_ID")).alias("PLAYERID"))
    return both.groupBy("PLAYERID").agg(F.min("DATE").alias("PLAY_DEBUT"), F.max("DATE").alias("PLAY_LASTGAME")).withColumn(
        "BIRTHDATE", date_lit("1970-01-01"))


def _log_sql(key: str, name: str) -> str:
    return f"""plays AS (SELECT log.*, 'S' || l_suppkey AS bat, 'N' || c_nationkey AS pit, c_nationkey FROM log JOIN customer ON o_custkey = c_custkey),
span AS (SELECT {key} AS k, min(d) AS debut, max(d) AS last_day FROM plays GROUP BY {key}),
numbered AS (SELECT *, {key} AS k, {name} AS name, row_number() OVER (PARTITION BY {key} ORDER BY {ORDER_SQL}) AS num FROM plays WHERE l_returnflag <> 'A')"""


def _means_sql(cuts) -> str:
    parts = [f"avg(CASE WHEN num <= {n} THEN x END) AS f{n}, avg(CASE WHEN num > {n} THEN x END) AS p{n}" for n in cuts]
    return "count(*) AS total, avg(x) AS career, any_value(name) AS name, " + ", ".join(parts)


def _published_sql(role: str, key: str, name: str, cuts, extra: str, ranking: str, kind: str, grades: dict, step: int, workload: list[str]) -> str:
    """``grades`` is {published name: (rounded mean, gate, scope, what not qualifying means in the simple form)}."""
    total = "CAREER_TOTAL_PA" if role == "BAT" else "CAREER_TOTAL_BF"
    rounded = ", ".join(f"{rounded_sql(f'{c}{n}', 3)} AS r{c}{n}" for n in cuts for c in "fp")
    lower = role == "PIT"
    graded = ", ".join(f"CASE WHEN {scope} THEN {grade_sql(v, 'total', gate, lower)} END AS {g}" for g, (v, gate, scope, _) in grades.items())
    simple = ", ".join(f"{g}, {simple_sql(g, dnq)} AS {g}_SIMPLE" for g, (*_, dnq) in grades.items())
    shown = ", ".join(f"rf{n} AS FIRST_{n}_WOBA, rp{n} AS POST_{n}_WOBA" for n in cuts)
    late = 4 * step
    return f"""WITH {LOG}, {_log_sql(key, name)}, {ranking},
m AS (SELECT k, {_means_sql(cuts)}{extra} FROM numbered GROUP BY k),
r AS (SELECT m.*, span.debut, span.last_day, rank, {rounded}, {rounded_sql("career", 3)} AS rcareer, {kind} AS kind
      FROM m JOIN span ON m.k = span.k LEFT JOIN ranking ON m.k = '{"S" if role == "BAT" else "N"}' || ranked_key),
g AS (SELECT *, {graded} FROM r)
SELECT k AS {role}_ID, name AS {role}_NAME, debut AS {role}_DEBUT, last_day AS {role}_LASTGAME, rank AS PROSPECT_RANK,
  {RANK_GROUP_SQL} AS PROSPECT_RANK_GROUP, CASE WHEN rank IS NULL THEN 'N' ELSE 'Y' END AS TOP_100_PROSPECT,
  rcareer AS CAREER_WOBA_{role}, total AS {total}, 'INACTIVE' AS PLAYER_STATUS, {"".join(w + ", " for w in workload)}{shown}, {simple},
  {rounded_sql(f"p{step} - f{step}", 3)} AS FIRST_POST_{step}_WOBA_DIFF, {rounded_sql(f"p{late} - f{late}", 3)} AS FIRST_POST_{late}_WOBA_DIFF
FROM g"""


@query(_published_sql(
    "BAT", "bat", "'Supplier ' || l_suppkey", BATTER_CUTS, "", ranking_sql("supplier", "s_suppkey", "s_acctbal"), "NULL", {
        "FIRST_150_WOBA_GRADE": ("rf150", 150, "true", "DNQ"), "FIRST_600_WOBA_GRADE": ("rf600", 600, "true", "DNQ"),
        "POST_150_WOBA_GRADE": ("rp150", 600, "true", "Bad"), "POST_600_WOBA_GRADE": ("rp600", 1800, "true", "Bad")}, 150, []))
def published_batters(spark, folder):
    plays = _plays(spark, folder)
    return players.publish_players(players.batters(plays, _people(plays), _latest(spark, folder)[0], ORDER), "BAT")


@query(_published_sql(
    "PIT", "pit", "'Nation ' || c_nationkey", PITCHER_CUTS,
    """, CASE WHEN NOT bool_or(c_nationkey % 5 = 0 AND l_quantity >= 50) THEN avg(CAST(l_quantity * 3 AS INTEGER)) END AS pitches,
    min(l_linenumber) AS first_inning, avg(l_linenumber) AS inning,
    CASE WHEN NOT bool_or(c_nationkey % 3 = 0 AND l_quantity <= 5) THEN avg(l_linenumber) END AS rest""",
    """ranking AS (SELECT n_nationkey AS ranked_key, 5 * row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) AS rank
      FROM nation WHERE n_regionkey <> 2)""",
    """CASE WHEN pitches >= 70 THEN 'STARTER' WHEN pitches <= 40 THEN 'RELIEVER' WHEN first_inning > 1 THEN 'RELIEVER'
      WHEN inning > 5.5 THEN 'RELIEVER' ELSE 'OTHER' END""", {
        "FIRST_215_WOBA_GRADE": ("rf215", 215, "true", "DNQ"), "FIRST_860_WOBA_GRADE_SP": ("rf860", 860, "kind = 'STARTER'", "DNQ"),
        "POST_215_WOBA_GRADE_SP": ("rp215", 860, "kind = 'STARTER'", "Bad"), "POST_215_WOBA_GRADE_NON_SP": ("rp215", 430, "kind <> 'STARTER'", "Bad"),
        "POST_860_WOBA_GRADE_SP": ("rp860", 2580, "kind = 'STARTER'", "Bad")}, 215, [
        f"{rounded_sql('pitches', 1)} AS AVG_PIT_COUNT", "first_inning AS IP_MIN", f"{rounded_sql('rest', 1)} AS AVG_DAYS_REST",
        f"{rounded_sql('inning', 1)} AS IP_MEAN", "kind AS PITCHER_TYPE"]))
def published_pitchers(spark, folder):
    """Nations ranked by region and key, one region unranked; means of workload under the strict null rule."""
    plays = _plays(spark, folder)
    return players.publish_players(players.pitchers(plays, _people(plays), _latest(spark, folder)[1], order=ORDER), "PIT")


def _latest(spark, folder):
    batting = balance_ranking(table(spark, folder, "supplier"), "s_suppkey", "s_acctbal").select(
        F.concat(F.lit("S"), F.col("ranked_key").cast("string")).alias("ID"), F.col("rank").alias("PROSPECT_RANK"))
    ranked = balance_ranking(table(spark, folder, "nation").filter("n_regionkey <> 2"), "n_nationkey", "n_regionkey")
    return batting, ranked.select(F.concat(F.lit("N"), F.col("ranked_key").cast("string")).alias("ID"), (F.col("rank") * 5).alias("PROSPECT_RANK"))


def _both_sql(role: str, key: str, cuts) -> str:
    shown = ", ".join(f"{rounded_sql(f'{c}{n}', 3)} AS {c}{k}" for k, n in enumerate(cuts, 1) for c in ("f", "p"))
    means = ", ".join(f"avg(CASE WHEN num <= {n} THEN x END) AS f{n}, avg(CASE WHEN num > {n} THEN x END) AS p{n}" for n in cuts)
    return f"""SELECT '{role}' AS role, k AS player, total, {rounded_sql("career", 3)} AS career, {shown} FROM (
      SELECT {key} AS k, count(*) AS total, avg(x) AS career, {means} FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ORDER_SQL}) AS num FROM plays WHERE l_returnflag <> 'A') GROUP BY {key})"""


@query(f"""WITH {LOG}, plays AS (SELECT log.*, 'S' || l_suppkey AS bat, 'N' || c_nationkey AS pit FROM log JOIN customer ON o_custkey = c_custkey)
{_both_sql("BAT", "bat", BATTER_CUTS)} UNION ALL {_both_sql("PIT", "pit", PITCHER_CUTS)}""")
def careers_of_both_roles(spark, folder):
    """Batters and pitchers from the same passes over the log: totals and first-N and after-N means."""
    plays = _plays(spark, folder)
    tables = players.both(plays, _people(plays), *_latest(spark, folder), order=ORDER)
    shown = []
    for df, role, total, cuts in zip(tables, players.ROLES, ("CAREER_TOTAL_PA", "CAREER_TOTAL_BF"), (BATTER_CUTS, PITCHER_CUTS)):
        first = ["QUARTILE_ONE_WOBA", *[f"FIRST_{n}_WOBA" for n in cuts[1:]]]
        shown.append(df.select(F.lit(role).alias("role"), F.col(f"{role}_ID").alias("player"), F.col(total).alias("total"), F.col(f"CAREER_WOBA_{role}").alias("career"),
                               *[F.col(c).alias(f"f{k}") for k, c in enumerate(first, 1)], *[F.col(f"POST_{n}_WOBA").alias(f"p{k}") for k, n in enumerate(cuts, 1)]))
    return shown[0].unionByName(shown[1])
