"""Profiles, ranges, prefixes, duplicates and other looks at the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import weeks_between
from ..operators import profiling
from ..operators.profiling import QUANTILES
from .base import query, rounded_sql, six, table

PROFILED = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string",
            "day": "date"}


def _profile_sql(c: str, kind: str) -> str:
    number, text = kind in ("bigint", "double"), kind == "string"
    shown = f"CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text"
    stats = [f"{rounded_sql(f'avg({c})', 6)} AS mean", f"{rounded_sql(f'stddev_samp({c})', 6)} AS sd"]
    stats += [f"{rounded_sql(f'quantile_cont(CAST({c} AS DOUBLE), {p})', 6)} AS {q}" for q, p in QUANTILES.items()]
    return f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
    CAST(count({c}) AS DOUBLE) / count(*) AS complete_rate, count(DISTINCT {c}) AS n_distinct,
    {shown if not number else 'NULL AS min_text, NULL AS max_text'},
    {f'min(length({c})) AS min_length, max(length({c})) AS max_length, count(CASE WHEN {c} = {chr(39) * 2} THEN 1 END) AS n_empty' if text
     else 'NULL AS min_length, NULL AS max_length, NULL AS n_empty'},
    {', '.join(stats) if number else ', '.join(f'NULL AS {n}' for n in ('mean', 'sd', *QUANTILES))} FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)"""


@query(" UNION ALL ".join(_profile_sql(c, k) for c, k in PROFILED.items()))
def profile(spark, folder):
    """All columns of the events, and their day as a date."""
    events = table(spark, folder, "events").withColumn("day", F.col("ts").cast("date"))
    return six(profiling.profile(events, list(PROFILED), exact=True), "mean", "sd", *QUANTILES)


@query(None)
def profile_one_pass(spark, folder):
    """Approximate distinct counts and quantiles, all columns in one pass; ``profile_within_error`` checks their errors."""
    return profiling.profile(table(spark, folder, "lineitem"))


EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query(" UNION ALL ".join(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS type, true AS nullable, count(*) > count({c}) AS has_missing FROM events"""
                          for i, (c, kind) in enumerate(EVENT_TYPES.items(), 1)))
def schema_listing(spark, folder):
    return profiling.schema_listing(table(spark, folder, "events"))


SKETCHED = {"l_orderkey": True, "l_partkey": True, "l_quantity": True, "l_extendedprice": True, "l_discount": True, "l_shipdate": False, "l_returnflag": False}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing, true AS distinct_within,
    {'true' if number else 'CAST(NULL AS BOOLEAN)'} AS quantiles_within FROM lineitem""" for c, number in SKETCHED.items()))
def profile_within_error(spark, folder):
    """Sketches of each return flag, merged, hold the errors that they state against all values."""
    lines = table(spark, folder, "lineitem")
    parts = profiling.merged(profiling.sketches(lines, list(SKETCHED), ["l_returnflag"]).withColumnRenamed("l_returnflag", "part"))
    return profiling.errors_held(lines, profiling.profile_of(parts, errors=True), list(SKETCHED))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity = 50")
def violations(spark, folder):
    return profiling.violations(table(spark, folder, "lineitem"), F.col("l_quantity") == 50).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


RANGED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""SELECT {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in RANGED)} FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1998-01-01'""")
def ranges(spark, folder):
    shipped = F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz"))
    return profiling.ranges(table(spark, folder, "lineitem"), RANGED, where=shipped)


@query("""SELECT l_returnflag, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount FROM lineitem WHERE l_discount <> 0 GROUP BY l_returnflag""")
def ranges_by_code(spark, folder):
    return profiling.ranges(table(spark, folder, "lineitem"), ["l_discount"], ["l_returnflag"], F.col("l_discount") != 0)


@query("SELECT min(CAST(o_orderdate AS DATE)) AS min_d, max(CAST(o_orderdate AS DATE)) AS max_d FROM orders")
def date_range(spark, folder):
    return profiling.ranges(table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("d")), ["d"])


@query("""WITH o AS (SELECT event_type, min(value) AS min_value, max(value) AS max_value FROM events WHERE value <> 0 GROUP BY event_type),
a AS (SELECT event_type, CAST(0.02 AS DOUBLE) AS allowed_low, max(value) AS allowed_high FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY event_type)
SELECT o.event_type, min_value, max_value, allowed_low, allowed_high FROM o JOIN a ON o.event_type = a.event_type WHERE min_value < allowed_low OR max_value > allowed_high""")
def range_violations(spark, folder):
    """Event types whose values leave the range seen in the first half of the month."""
    events = table(spark, folder, "events")
    observed = profiling.ranges(events, ["value"], ["event_type"], F.col("value") != 0)
    early = events.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    allowed = early.groupBy("event_type").agg(F.lit(0.02).alias("allowed_low"), F.max("value").alias("allowed_high"))
    return profiling.range_violations(observed, allowed, ["event_type"], "min_value", "max_value")


@query("SELECT substr(event_type, 1, 1) AS prefix, user_id, count(*) AS n FROM events GROUP BY ALL")
def prefix_counts(spark, folder):
    return profiling.prefix_counts(table(spark, folder, "events"), "event_type", 1, ["user_id"])


@query("SELECT substr(o_orderpriority, 1, 3) AS prefix, o_orderstatus, count(*) AS n FROM orders WHERE substr(o_orderpriority, 1, 1) = '4' GROUP BY ALL")
def prefix_drill_down(spark, folder):
    return profiling.prefix_counts(table(spark, folder, "orders"), "o_orderpriority", 3, ["o_orderstatus"], F.col("o_orderpriority").startswith("4"))


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2")
def duplicate_keys(spark, folder):
    return profiling.duplicate_keys(table(spark, folder, "part"), ["p_name", "p_brand"])


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def value_counts(spark, folder):
    return profiling.value_counts(table(spark, folder, "part"), "p_type")


@query("SELECT *, count(*) AS n_copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark, folder):
    return profiling.duplicate_rows(table(spark, folder, "lineitem"))


@query("""SELECT * FROM (
SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS group_size FROM lineitem) WHERE group_size > 7""")
def oversized_groups(spark, folder):
    return profiling.oversized_groups(table(spark, folder, "lineitem"), ["l_orderkey"], 7)


@query("""SELECT p_name, p_brand, n_values FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n_values FROM (SELECT DISTINCT p_name, p_brand FROM part))
WHERE n_values > 1""")
def ambiguous_keys(spark, folder):
    return profiling.ambiguous_keys(table(spark, folder, "part"), "p_name", "p_brand")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 5")
def inspect(spark, folder):
    return profiling.inspect(table(spark, folder, "events"), "user_id", 5, ["event_id", "event_type", "value"], ["ts", "event_id"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gap FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 7.0 AS gap
FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE NOT (gap BETWEEN -100 AND 200)""")
def gap_outliers(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gaps = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", weeks_between("l_shipdate", "o_orderdate").alias("gap"))
    return profiling.gap_outliers(gaps, "gap", -100, 200)
