"""Numbering, running means, milestones, group ends and extremes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import years_from_weeks
from ..operators import sequence as seq
from ..operators.report import occurrence_rate
from ..operators.stats import exact_quantiles as quantiles
from ..operators.skew import join_back
from .base import (LINE_KEY, LOG, ORDER, ORDER_SQL, heavy_customers, heavy_suppliers, line_log, numbered_sql, query, rounded_sql, six, supplier_numbered,
                   table)

EVENT_ORDER = ["ts", "event_id"]
CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"


def _events(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_num FROM events""")
def number_events(spark, folder):
    return seq.number_events(_events(spark, folder), "user_id", EVENT_ORDER).select("event_id", "user_id", "event_num")


@query(f"""WITH e AS (SELECT *, {CENTS} AS cents FROM events)
SELECT event_id, user_id, CAST(sum(cents) OVER w AS DOUBLE) / count(cents) OVER w AS running_mean FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_mean(spark, folder):
    return seq.running_mean(_events(spark, folder), "user_id", EVENT_ORDER, "cents").select("event_id", "user_id", "running_mean")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS group_total FROM events""")
def group_total(spark, folder):
    return seq.group_total(_events(spark, folder), "user_id").select("event_id", "user_id", "group_total")


@query(f"""WITH e AS (SELECT *, {CENTS} AS cents FROM events)
SELECT event_id, user_id, avg(cents) OVER (PARTITION BY user_id) AS group_mean FROM e""")
def group_mean(spark, folder):
    return seq.group_mean(_events(spark, folder), "user_id", "cents").select("event_id", "user_id", "group_mean")


@query(f"""WITH {LOG}, numbered AS (
  SELECT *, row_number() OVER s AS num, count(*) OVER (PARTITION BY l_suppkey) AS total,
         sum(x) OVER s / count(x) OVER s AS rolling, avg(x) OVER (PARTITION BY l_suppkey) AS career
  FROM log WINDOW s AS (PARTITION BY l_suppkey ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, num, total, rolling, career FROM numbered""")
def annotated_supplier_log(spark, folder):
    """Number, total, running mean and career mean of each line, from one partitioning."""
    out = seq.annotate(line_log(spark, folder), "l_suppkey", ORDER, number="num", size="total", running_means={"rolling": "x"},
                       group_means={"career": "x"}, heavy=heavy_suppliers(spark, folder))
    return out.select(*LINE_KEY, "num", "total", "rolling", "career")


@query(f"""WITH {LOG}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER_SQL}) AS supplier_num,
  row_number() OVER (PARTITION BY o_custkey ORDER BY {ORDER_SQL}) AS customer_num,
  count(*) OVER (PARTITION BY l_suppkey) AS supplier_total, count(*) OVER (PARTITION BY o_custkey) AS customer_total
FROM log""")
def number_two_roles(spark, folder):
    """Both roles of every line: two shuffles by design."""
    log = line_log(spark, folder)
    first = seq.annotate(log, "l_suppkey", ORDER, number="supplier_num", size="supplier_total",
                         heavy=heavy_suppliers(spark, folder))
    both = seq.annotate(first, "o_custkey", ORDER, number="customer_num", size="customer_total", heavy=heavy_customers(log, folder))
    return both.select(*LINE_KEY, "o_custkey", "supplier_num", "customer_num", "supplier_total", "customer_total")


BUCKETS = {"q1": (1, 150), "q2": (151, 300), "q3": (301, 450), "q4": (451, 600)}
CUTS = [150, 300, 450, 600]


@query(f"""WITH {LOG}, {numbered_sql("l_suppkey")} SELECT l_suppkey,
{", ".join(f"avg(CASE WHEN num BETWEEN {a} AND {b} THEN x END) AS {q}" for q, (a, b) in BUCKETS.items())}
FROM numbered GROUP BY l_suppkey""")
def milestone_means_supplier(spark, folder):
    log = supplier_numbered(spark, folder)
    return seq.milestone_means(log, "l_suppkey", "num", {q: ("x", a, b) for q, (a, b) in BUCKETS.items()})


@query(f"""WITH {LOG}, {numbered_sql("l_suppkey")} SELECT l_suppkey,
{", ".join(f"avg(CASE WHEN num <= {n} THEN x END) AS first_{n}, avg(CASE WHEN num > {n} THEN x END) AS post_{n}" for n in CUTS)}
FROM numbered GROUP BY l_suppkey""")
def split_means(spark, folder):
    log = supplier_numbered(spark, folder)
    return seq.split_means(log, "l_suppkey", "num", "x", CUTS)


@query(f"""WITH {LOG}, {numbered_sql("l_suppkey")},
m AS (SELECT l_suppkey, avg(CASE WHEN num <= 150 THEN x END) AS first_150, avg(CASE WHEN num > 150 THEN x END) AS post_150
      FROM numbered GROUP BY l_suppkey)
SELECT l_suppkey, first_150, post_150, {rounded_sql("post_150 - first_150", 3)} AS diff FROM m""")
def split_difference(spark, folder):
    log = supplier_numbered(spark, folder)
    means = seq.split_means(log, "l_suppkey", "num", "x", [150])
    return seq.split_diff(means, "first_150", "post_150", "diff")


@query(f"""WITH {LOG}, {numbered_sql("l_suppkey")}, born AS (SELECT l_suppkey AS k, min(d) AS birth FROM log GROUP BY l_suppkey),
days AS (SELECT l_suppkey, num, date_diff('day', DATE '1970-01-01', d) AS day, date_diff('day', DATE '1970-01-01', birth) AS born
         FROM numbered JOIN born ON l_suppkey = k)
SELECT l_suppkey, {", ".join(f"(avg(CASE WHEN num BETWEEN {a} AND {b} THEN day END) - born) / 7.0 / 52.0 AS {q}_age" for q, (a, b) in BUCKETS.items())}
FROM days GROUP BY l_suppkey, born""")
def milestone_age(spark, folder):
    """Mean age in each bucket, in years of 52 weeks, counted from the first order."""
    log = supplier_numbered(spark, folder).withColumn("day", F.unix_date("d"))
    means = seq.milestone_means(log, "l_suppkey", "num", {q: ("day", a, b) for q, (a, b) in BUCKETS.items()},
                                [F.min("day").alias("born")])
    return means.select("l_suppkey", *[years_from_weeks((F.col(q) - F.col("born")) / 7.0).alias(f"{q}_age") for q in BUCKETS])


@query("""WITH born AS (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS birth FROM orders GROUP BY o_custkey)
SELECT o_orderkey, date_diff('day', birth, CAST(o_orderdate AS DATE)) / 7.0 AS age_wks,
       date_diff('day', birth, CAST(o_orderdate AS DATE)) / 7.0 / 52.0 AS age_yrs
FROM orders JOIN born ON o_custkey = k""")
def age_at(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    born = orders.groupBy("o_custkey").agg(F.min("d").alias("birth"))
    return seq.age_at(join_back(orders, born, ["o_custkey"]), "d", "birth").select("o_orderkey", "age_wks", "age_yrs")


@query("""SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_attributes(spark, folder):
    return seq.latest_attributes(table(spark, folder, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"],
                                 ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@query(f"""WITH {LOG} SELECT l_suppkey, count(*) AS total, avg(x) AS mean FROM log GROUP BY l_suppkey""")
def entity_totals(spark, folder):
    return seq.entity_totals(line_log(spark, folder), "l_suppkey", "x")


@query("""SELECT l_suppkey, avg(l_quantity) AS avg_quantity, avg(l_linenumber) AS avg_line, min(l_linenumber) AS min_line
FROM lineitem GROUP BY l_suppkey""")
def workload(spark, folder):
    return seq.workload(table(spark, folder, "lineitem"), "l_suppkey",
                        {"avg_quantity": "l_quantity", "avg_line": "l_linenumber"}, {"min_line": "l_linenumber"})


PRICED = "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END"


@query(f"""WITH p AS (SELECT o_custkey, o_orderkey, {PRICED} AS price FROM orders)
SELECT o_custkey, CASE WHEN count(price) = count(*) THEN min(price) END AS min_price,
       CASE WHEN count(price) = count(*) THEN avg(o_orderkey) END AS mean_key FROM p GROUP BY o_custkey""")
def workload_null_policy(spark, folder):
    """Aggregates that are NULL as soon as one input is: the price of pending orders counts as unknown."""
    known = F.col("o_orderstatus") != "P"
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.when(known, F.col("o_totalprice")).alias("price"), F.when(known, F.col("o_orderkey")).alias("known_key"),
        "o_orderkey")
    mins = seq.workload(orders, "o_custkey", {"mean_known": "known_key"}, {"min_price": "price"}, "propagate")
    return mins.select("o_custkey", "min_price", F.col("mean_known").alias("mean_key"))


@query("""SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""")
def tail_n(spark, folder):
    return seq.tail_n(table(spark, folder, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 2)


TAIL_SQL = """WITH t AS (SELECT conv_id, turn, role, length(text) AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE turn > 0),
ends AS (SELECT *, count(CASE WHEN size > 200 THEN 1 END) OVER (PARTITION BY conv_id) AS hits FROM t WHERE rn <= 2)"""


def _tail_matches(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))
    return turns, seq.tail_matches(turns, "conv_id", ["turn"], 2, F.col("size") > 200, F.col("turn") > 0)


@query(TAIL_SQL + " SELECT conv_id, turn, role, size FROM ends WHERE hits = 2")
def tail_matches(spark, folder):
    """Conversations whose last two turns after the first are both long."""
    return _tail_matches(spark, folder)[1]


@query(TAIL_SQL + """, h AS (SELECT count(DISTINCT conv_id) AS n_hits FROM ends WHERE hits = 2),
a AS (SELECT count(DISTINCT conv_id) AS n_total FROM conversations)
SELECT n_total, n_hits, CAST(n_hits AS DOUBLE) / n_total * 100.0 AS pct, CASE WHEN n_hits > 0 THEN CAST(n_total AS DOUBLE) / n_hits END AS one_in FROM a, h""")
def tail_rate(spark, folder):
    turns, hits = _tail_matches(spark, folder)
    return occurrence_rate(turns, hits, "conv_id")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m""")
def arg_max_rows(spark, folder):
    return seq.arg_max_rows(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, d FROM (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, min(o_orderdate) OVER (PARTITION BY o_custkey) AS m, o_orderdate FROM orders)
WHERE o_orderdate = m""")
def arg_min_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return seq.arg_min_rows(orders, "o_custkey", "d")


@query("""SELECT o_custkey, debut FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS debut FROM orders GROUP BY o_custkey)
WHERE debut > DATE '1995-03-01' AND debut < DATE '1996-01-01'""")
def cohort(spark, folder):
    debuts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("debut"))
    return seq.cohort(debuts, "debut", after="1995-03-01", before="1996-01-01")


QUANTILES = {"q25": 0.25, "q50": 0.5, "q90": 0.9}


@query(f"""SELECT user_id, {", ".join(f"{rounded_sql(f'quantile_cont(value, {p})', 6)} AS {q}" for q, p in QUANTILES.items())}
FROM events GROUP BY user_id""")
def exact_quantiles(spark, folder):
    return six(quantiles(table(spark, folder, "events"), "value", QUANTILES, ["user_id"]), *QUANTILES)
