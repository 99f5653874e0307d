"""Typed reading of text, values that do not parse, tables written and read again, scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn
from ..sources import delimited, stages
from .base import query, rounded_sql, table

# Order dates as text; for pending orders only the year is known, and some prices are words.
TEXT = """t AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN '00/00/' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS o_orderdate,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'unknown' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS o_totalprice FROM orders)"""
SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.DateType()), T.StructField("o_totalprice", T.DoubleType())])
DATES = {"o_orderdate": "MM/dd/yyyy"}


def _text(spark, folder):
    pending, urgent = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(pending, F.concat(F.lit("00/00/"), F.date_format("o_orderdate", "yyyy"))).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("o_orderdate"),
        F.when(urgent, "unknown").otherwise(F.floor("o_totalprice").cast("string")).alias("o_totalprice"))


@query(f"""WITH {TEXT} SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(try_strptime(o_orderdate, '%m/%d/%Y') AS DATE) AS o_orderdate,
TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM t""")
def read_dates(spark, folder):
    return delimited.apply_types(_text(spark, folder), SCHEMA, DATES)


@query(f"""WITH {TEXT} SELECT o_orderkey, 'o_orderdate' AS "column", o_orderdate AS raw_value, 'date MM/dd/yyyy' AS expected FROM t WHERE try_strptime(o_orderdate, '%m/%d/%Y') IS NULL
UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice, 'double' FROM t WHERE TRY_CAST(o_totalprice AS DOUBLE) IS NULL""")
def parse_problems(spark, folder):
    typed = T.StructType([f for f in SCHEMA if f.name != "o_orderkey"])
    return delimited.parse_problems(_text(spark, folder), typed, DATES, ["o_orderkey"])


@query(f"""WITH {TEXT} SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(try_strptime(o_orderdate, '%m/%d/%Y') AS DATE) AS o_orderdate,
TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM t""")
def csv_round_trip(spark, folder):
    """Orders written as CSV text and read back with declared types."""
    path = f"{stages.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    delimited.write_table(_text(spark, folder), path, "csv")
    return delimited.read_csv(spark, path, SCHEMA, DATES)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(floor(o_totalprice) AS DOUBLE) AS o_totalprice FROM orders""")
def csv_by_header(spark, folder):
    """Orders written as CSV with more columns and another order, of which the declared ones are read by name."""
    path = f"{stages.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", F.floor("o_totalprice").alias("o_totalprice"), "o_orderpriority", "o_orderkey", "o_custkey",
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"))
    delimited.write_table(orders, path, "csv")
    return delimited.read_csv(spark, path, SCHEMA, DATES)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS o_totalprice FROM orders""")
def csv_other_headers(spark, folder):
    """A folder of CSV files with three headers: other orders of columns, a further column, and one file set without the price."""
    path = f"{stages.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o_totalprice"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"))
    for k, columns in enumerate((["o_orderkey", "o_orderdate", "o_totalprice"], ["o_totalprice", "o_custkey", "o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderkey"])):
        delimited.write_table(orders.filter(F.col("o_custkey") % 3 == k).select(*columns), path, "csv", mode="append")
    return delimited.read_csv(spark, path, SCHEMA, DATES, absent="null")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def stage_round_trip(spark, folder):
    """Customers saved as a stage and loaded again."""
    base, name = stages.shared_folder(spark), f"customer-{uuid.uuid4().hex}"
    stages.save_stage(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), name, base)
    return stages.load_stage(spark, name, base)


@query(f"""SELECT o_orderkey, substr(o_orderpriority, 3, 100) AS words, array_to_string(list_transform(string_split(substr(o_orderpriority, 3, 100), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2, 100))), ' ') AS titled,
regexp_replace(o_orderpriority, 'E', 'e') AS replaced, concat_ws(' ', o_orderstatus, nullif(o_orderpriority, '5-LOW')) AS joined,
make_date(year(o_orderdate), 1, 1) AS new_year, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7.0 AS weeks,
date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7.0 / 52.0 AS years, {rounded_sql("o_totalprice / 1000.0", 1)} AS thousands,
CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'P' THEN 'open' ELSE 'closed' END AS state,
(nullif(o_orderstatus, 'O') IS NULL OR o_orderstatus NOT IN ('F')) AS not_finished,
CAST(floor(o_totalprice / 1000000.0 * 1000.0 + 0.5) AS BIGINT) AS milli FROM orders""")
def scalar_functions(spark, folder):
    orders = table(spark, folder, "orders")
    priority = F.col("o_orderpriority")
    known = F.when(priority != "5-LOW", F.col("o_orderstatus") == "P")
    words = F.substring(priority, 3, 100)
    return orders.select(
        "o_orderkey", words.alias("words"), fn.title_case(words).alias("titled"), fn.replace_first(priority, "E", "e").alias("replaced"),
        fn.full_name("o_orderstatus", F.when(priority != "5-LOW", priority)).alias("joined"),
        fn.year_date(F.year("o_orderdate")).alias("new_year"), fn.weeks_between("o_orderdate", fn.date_lit("1995-01-01")).alias("weeks"),
        fn.years_from_weeks(fn.weeks_between("o_orderdate", fn.date_lit("1995-01-01"))).alias("years"),
        fn.round_half_up(F.col("o_totalprice") / 1000.0, 1).alias("thousands"), fn.if_else(known, F.lit("open"), F.lit("closed")).alias("state"),
        fn.not_in(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), ["F"]).alias("not_finished"),
        fn.thousandths(F.col("o_totalprice") / 1000000.0).alias("milli"))
