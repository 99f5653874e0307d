"""Ranking lists made from yearly order totals; names resolved to customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import year_date
from ..operators import resolve
from ..operators.classify import rank_group
from ..operators.profiling import unresolved as unresolved_names
from ..operators.report import debut_rate as rate
from ..operators.report import distinct_by as distinct
from ..operators.report import last_listed as last
from ..operators.resolve import Correction, Step
from ..operators.skew import join_known
from .base import query, saved, table

# Yearly lists of the 100 customers with the largest order totals; names of one segment are written in capitals.
LISTS = """totals AS (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS cents FROM orders GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY cents DESC, o_custkey) AS rn FROM totals),
lists AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS name, CAST(rn AS INTEGER) AS rank, make_date(y, 1, 1) AS year,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END AS position, CASE WHEN c_nationkey = 24 THEN c_custkey END AS id
  FROM placed JOIN customer ON o_custkey = c_custkey WHERE rn <= 100)"""


def yearly_lists(spark, folder):
    """Written once, like any input list: the steps below read it several times. A list has 100 rows a year however
    many orders there are, so those steps need not look for oversized names (``heavy=None``).
    """
    totals = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")).alias("cents"))
    w = Window.partitionBy("y").orderBy(F.col("cents").desc(), "o_custkey")
    placed = totals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 100)
    listed = placed.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    shouted = F.when(F.col("c_mktsegment") == "BUILDING", F.upper("c_name")).otherwise(F.col("c_name"))
    return saved(listed.select(shouted.alias("name"), "rank", year_date("y").alias("year"),
                         F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2).alias("position"),
                         F.when(F.col("c_nationkey") == 24, F.col("c_custkey")).alias("id")), "lists")


# ---- the cascade -----------------------------------------------------------

RESOLVED = LISTS + """, step12 AS (SELECT name, rank, year, position, coalesce(id, a.c_custkey, b.c_custkey) AS id,
    CASE WHEN id IS NOT NULL THEN 0 WHEN a.c_custkey IS NOT NULL THEN 1 WHEN b.c_custkey IS NOT NULL THEN 2 END AS resolved_by
  FROM lists LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 8) a ON name = a.c_name
             LEFT JOIN (SELECT * FROM customer WHERE c_nationkey BETWEEN 8 AND 12) b ON name = b.c_name),
resolved AS (SELECT CASE WHEN id IS NULL THEN coalesce(alias.c_name, name) ELSE name END AS name, rank, year, position,
    coalesce(id, last.c_custkey) AS id, coalesce(resolved_by, CASE WHEN last.c_custkey IS NOT NULL THEN 3 END) AS resolved_by
  FROM step12 LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') alias ON name = upper(alias.c_name)
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 1000) last ON coalesce(alias.c_name, name) = last.c_name AND id IS NULL)"""


def _aliases(spark, folder):
    shouted = table(spark, folder, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return shouted.select(F.upper("c_name").alias("name"), F.col("c_name").alias("canonical_name"))


def resolved_lists(spark, folder):
    customer = table(spark, folder, "customer")
    return resolve.resolve_cascade(yearly_lists(spark, folder), [
        Step(customer, "c_name", "c_custkey", F.col("c_nationkey") < 8),
        Step(customer, "c_name", "c_custkey", F.col("c_nationkey").between(8, 12)),
        Step(customer, "c_name", "c_custkey", F.col("c_acctbal") > 1000, aliased=True)],
        name="name", id="id", aliases=_aliases(spark, folder), heavy=None)


@query(f"WITH {RESOLVED} SELECT name, rank, year, position, id, resolved_by FROM resolved")
def resolve_cascade(spark, folder):
    return resolved_lists(spark, folder)


@query(f"WITH {RESOLVED} SELECT name, count(*) AS n FROM resolved WHERE id IS NULL GROUP BY name")
def unresolved(spark, folder):
    return unresolved_names(resolved_lists(spark, folder), "id", "name")


@query(f"""WITH {LISTS} SELECT name, rank, year, coalesce(id, c_custkey) AS id FROM lists
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 1000) ON name = c_name""")
def resolve_step(spark, folder):
    out = resolve.resolve_step(yearly_lists(spark, folder), table(spark, folder, "customer"), "name", "id", "c_name", "c_custkey", F.col("c_acctbal") > 1000, None)
    return out.select("name", "rank", "year", "id")


@query(f"""WITH {LISTS} SELECT coalesce(c_name, name) AS name, rank, year FROM lists
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON name = upper(c_name)""")
def apply_aliases(spark, folder):
    return resolve.apply_aliases(yearly_lists(spark, folder), _aliases(spark, folder), "name", heavy=None).select("name", "rank", "year")


# Names of two digits, which many customers share.
SHORT = f"""short AS (SELECT 'C' || right(name, 2) AS name, id FROM lists),
people AS (SELECT 'C' || right(c_name, 2) AS name, c_custkey AS id,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 100 < 40 THEN 1 WHEN c_custkey % 7 = 0 AND c_custkey % 100 < 70 THEN 2 END AS given, c_custkey % 11 = 0 AS known FROM customer),
fixed AS (SELECT name, CASE WHEN right(name, 1) = '0' THEN left(name, 2) || '1' ELSE name END AS canonical FROM short),
g AS (SELECT name, id, step, min(step) OVER (PARTITION BY name) AS first FROM (SELECT name, id, given AS step FROM people WHERE given IS NOT NULL)),
open1 AS (SELECT name, count(*) AS n_rows FROM short WHERE id IS NULL GROUP BY name),
open2 AS (SELECT CASE WHEN right(name, 1) = '0' THEN left(name, 2) || '1' ELSE name END AS name, sum(n_rows) AS n_rows
  FROM open1 WHERE name NOT IN (SELECT name FROM g) GROUP BY ALL),
review AS (
  SELECT 'given' AS form, name, any_value(first) AS resolved_by, count(CASE WHEN step = first THEN 1 END) AS n_candidates,
    string_agg(CASE WHEN step = first THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS candidates,
    coalesce(string_agg(CASE WHEN step > first THEN CAST(id AS VARCHAR) END, ',' ORDER BY id), '') AS other_sources, any_value(n_rows) AS n_rows
  FROM g JOIN open1 USING (name) GROUP BY name HAVING count(CASE WHEN step = first THEN 1 END) > 1
  UNION ALL
  SELECT 'corrected', name, 3, count(*), string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '', any_value(n_rows)
  FROM people JOIN open2 USING (name) WHERE known GROUP BY name HAVING count(*) > 1)"""


def _short_names(spark, folder):
    def short(c):
        return F.concat(F.lit("C"), F.substring(c, -2, 2))

    lists = yearly_lists(spark, folder).select(short("name").alias("name"), "id")
    people = table(spark, folder, "customer").select(short("c_name").alias("c_name"), "c_custkey")
    key = F.col("c_custkey")
    first, second = (key % 3 == 0) & (key % 100 < 40), (key % 7 == 0) & (key % 100 < 70)
    steps = [Step(people, "c_name", "c_custkey", first), Step(people, "c_name", "c_custkey", second & ~first),
             Step(people, "c_name", "c_custkey", key % 11 == 0, aliased=True)]
    aliases = {f"C{d}0": f"C{d}1" for d in range(10)}
    return lists, steps, aliases


@query(f"WITH {LISTS}, {SHORT} SELECT *, (n_candidates - 1) * CAST(n_rows AS BIGINT) AS extra_rows FROM (SELECT form, name, resolved_by, n_candidates, candidates, other_sources, CAST(n_rows AS BIGINT) AS n_rows FROM review)")
def cascade_review(spark, folder):
    """Names that several customers share, with what each adds to the resolved lists."""
    lists, steps, aliases = _short_names(spark, folder)
    found = resolve.cascade_review(lists, steps, name="name", id="id", aliases=aliases, heavy=None)
    return found.withColumns({c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",") for c in ("candidates", "other_sources")})


@query(f"""WITH {LISTS}, {SHORT}, n AS (SELECT (SELECT count(*) FROM short) AS rows_before, (SELECT CAST(coalesce(sum((n_candidates - 1) * n_rows), 0) AS BIGINT) FROM review) AS extra_rows)
SELECT rows_before, extra_rows, rows_before + extra_rows AS rows_after FROM n""")
def cascade_balance(spark, folder):
    """Rows before, rows that the review lists as extra, and rows after the cascade, which are the sum."""
    lists, steps, aliases = _short_names(spark, folder)
    review = resolve.cascade_review(lists, steps, name="name", id="id", aliases=aliases, heavy=None)
    after = resolve.resolve_cascade(lists, steps, name="name", id="id", aliases=aliases, heavy=None)
    zero = F.lit(0).cast("long")
    counted = (lists.select(F.lit(1).cast("long").alias("b"), zero.alias("e"), zero.alias("a"))
               .unionByName(review.select(zero.alias("b"), F.col("extra_rows").alias("e"), zero.alias("a")))
               .unionByName(after.select(zero.alias("b"), zero.alias("e"), F.lit(1).cast("long").alias("a"))))
    return counted.agg(F.sum("b").alias("rows_before"), F.sum("e").alias("extra_rows"), F.sum("a").alias("rows_after"))


RULES = (
    Correction({"p_brand": "Brand#1", "p_type": "SMALL"}, {"p_name": None}),
    Correction({"p_brand": "Brand#1"}, {"p_brand": "Brand#01", "p_name": "renamed"}),
    Correction({"p_type": "ECONOMY", "p_size": 11}, drop_row=True),
    Correction({"p_name": "small ring"}, {"p_name": "Small Ring"}),
)


@query("""SELECT p_partkey, CASE rule WHEN 1 THEN NULL WHEN 2 THEN 'renamed' WHEN 4 THEN 'Small Ring' ELSE p_name END AS p_name,
CASE rule WHEN 2 THEN 'Brand#01' ELSE p_brand END AS p_brand, p_type, p_size FROM (SELECT *,
  CASE WHEN p_brand = 'Brand#1' AND p_type = 'SMALL' THEN 1 WHEN p_brand = 'Brand#1' THEN 2 WHEN p_type = 'ECONOMY' AND p_size = 11 THEN 3
       WHEN p_name = 'small ring' THEN 4 ELSE 0 END AS rule FROM part) WHERE rule <> 3""")
def apply_corrections(spark, folder):
    return resolve.apply_corrections(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), RULES)


# ---- rank at debut ---------------------------------------------------------

DEBUTS = "debuts AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS debut FROM orders GROUP BY o_custkey)"
GAPS = f"""{RESOLVED}, {DEBUTS}, gaps AS (SELECT name, rank, year, position, id, debut, date_diff('day', debut, year) / 7.0 AS gap_wks
  FROM resolved LEFT JOIN debuts ON id = o_custkey)"""
LATEST = f"""{GAPS}, latest AS (SELECT * FROM (SELECT *, max(gap_wks) OVER (PARTITION BY id) AS best,
    count(*) OVER (PARTITION BY id) - count(gap_wks) OVER (PARTITION BY id) AS unknown FROM gaps WHERE id IS NOT NULL)
  WHERE gap_wks = best AND unknown = 0 AND gap_wks > -52)"""


def _gaps(spark, folder):
    """Written once: callers read the resolved lists, 100 rows a year, several times."""
    debuts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("_k")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("debut"))
    dated = join_known(resolved_lists(spark, folder).drop("resolved_by"), debuts, "id", "_k").drop("_k")
    return saved(resolve.rank_gap(dated, "year", "debut"), "gaps")


@query(f"WITH {GAPS} SELECT name, rank, year, position, id, debut, gap_wks FROM gaps")
def rank_gap(spark, folder):
    return _gaps(spark, folder)


@query(f"WITH {LATEST} SELECT name, rank, year, position, id, debut, gap_wks FROM latest")
def latest_ranking(spark, folder):
    return resolve.latest_ranking(_gaps(spark, folder), "id", "gap_wks", heavy=None)


@query(f"""WITH {LATEST} SELECT c_custkey, rank, CASE WHEN rank IS NULL THEN 'Unranked' WHEN rank <= 25 THEN '1 - 25' WHEN rank <= 50 THEN '26 - 50'
WHEN rank <= 75 THEN '51 - 75' ELSE '76 - 100' END AS rank_group FROM customer LEFT JOIN latest ON c_custkey = id""")
def attach_ranking(spark, folder):
    latest = resolve.latest_ranking(_gaps(spark, folder), "id", "gap_wks", heavy=None)
    out = resolve.attach_ranking(table(spark, folder, "customer").select("c_custkey"), latest, "c_custkey", "id", "rank")
    return out.withColumn("rank_group", rank_group("rank"))


NEVER = "never AS (SELECT * FROM (SELECT *, max(year) OVER (PARTITION BY name) AS last_year FROM gaps WHERE id IS NULL) WHERE year = last_year)"


@query(f"WITH {GAPS}, {NEVER} SELECT name, rank, year FROM never")
def last_listed(spark, folder):
    gaps = _gaps(spark, folder)
    return last(gaps.filter(F.col("id").isNull()), "name", "year", heavy=None).select("name", "rank", "year")


RANKS = "CASE WHEN rank <= 25 THEN '1 - 25' WHEN rank <= 50 THEN '26 - 50' WHEN rank <= 75 THEN '51 - 75' ELSE '76 - 100' END"


@query(f"""WITH {LATEST}, {NEVER}, every AS (SELECT rank, year, position, debut FROM never UNION ALL SELECT rank, year, position, debut FROM latest),
l AS (SELECT {RANKS} AS rank_group, CASE WHEN debut IS NOT NULL THEN 'Yes' ELSE 'No' END AS debuted FROM every WHERE year < DATE '2000-01-01' AND position <> 1),
k AS (SELECT rank_group, debuted, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(['1 - 25', '26 - 50', '51 - 75', '76 - 100']) AS rank_group)
  CROSS JOIN (SELECT unnest(['Yes', 'No']) AS debuted)) LEFT JOIN (SELECT rank_group, debuted, count(*) AS n FROM l GROUP BY ALL) USING (rank_group, debuted)),
t AS (SELECT coalesce(rank_group, 'Total') AS rank_group, coalesce(debuted, 'Total') AS debuted, CAST(sum(n) AS BIGINT) AS n FROM k
  GROUP BY GROUPING SETS ((rank_group, debuted), (rank_group), (debuted), ()))
SELECT t.rank_group, t.debuted, t.n, CASE WHEN r.n > 0 THEN CAST(t.n AS DOUBLE) / r.n END AS pct,
  CASE WHEN r.n > 0 THEN CAST(CAST(floor(CAST(t.n AS DOUBLE) / r.n * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%' ELSE '-' END || ' (' || CAST(t.n AS VARCHAR) || ')' AS label
FROM t JOIN t r ON t.rank_group = r.rank_group AND r.debuted = 'Total'""")
def debut_rate(spark, folder):
    return rate(_gaps(spark, folder), name="name", entity="id", year="year", rank="rank", debut="debut", gap="gap_wks",
                role=F.col("position") != 1, before="2000-01-01", heavy=None)


@query(f"""WITH {GAPS}, open AS (SELECT DISTINCT name FROM gaps WHERE id IS NULL AND year > DATE '1996-01-01'),
upd AS (SELECT c_name, c_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM customer JOIN orders ON c_custkey = o_custkey
  WHERE c_acctbal > 500 AND c_name <> 'Customer#000000007' GROUP BY ALL),
filled AS (SELECT gaps.name, rank, year, coalesce(id, c_custkey) AS id, coalesce(debut, d) AS debut FROM gaps
  LEFT JOIN (SELECT upd.* FROM upd JOIN open ON c_name = open.name) ON gaps.name = c_name)
SELECT name, rank, year, id, debut, CASE WHEN debut <= DATE '1995-06-01' THEN date_diff('day', debut, year) / 7.0 END AS gap_wks FROM filled""")
def refresh_ids(spark, folder):
    update = table(spark, folder, "customer").filter(F.col("c_acctbal") > 500).join(
        table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_name", "c_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_day"))
    return resolve.refresh_ids(
        _gaps(spark, folder).drop("position"), update, name="name", id="id", year="year", debut="debut", gap="gap_wks",
        update_name="c_name", update_id="c_custkey", update_debut="first_day", ranked_after="1996-01-01",
        gap_null_after="1995-06-01", exclude=["Customer#000000007"], heavy=None)


# ---- set operations --------------------------------------------------------

@query("""SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def union_by_name(spark, folder):
    """Tables appended by column name; columns that one side lacks are NULL there."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT DISTINCT p_name, p_type FROM part")
def distinct_by(spark, folder):
    return distinct(table(spark, folder, "part"), ["p_name", "p_type"])
