import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from careerspark.operators import sequence as seq
from careerspark.operators import skew

VALUES = [0.0, 0.9, 0.0, 1.2, 0.9]


def events(spark, rows=None):
    rows = rows or [("a", i, v) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "e string, i int, x double")


def test_running_mean(spark):
    got = [r.running_mean for r in seq.running_mean(events(spark), "e", ["i"], "x").orderBy("i").collect()]
    assert got == pytest.approx([0, 0.45, 0.30, 0.525, 0.60])


def test_running_mean_skips_nulls(spark):
    rows = [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0)]
    got = [r.running_mean for r in seq.running_mean(events(spark, rows), "e", ["i"], "x").orderBy("i").collect()]
    assert got == [None, 2.0, 2.0, 3.0]


def test_split_at_two(spark):
    log = seq.number_events(events(spark), "e", ["i"], "num")
    row = seq.split_diff(seq.split_means(log, "e", "num", "x", [2]), "first_2", "post_2", "diff").first()
    assert (row.first_2, row.post_2, row["diff"]) == pytest.approx((0.45, 0.70, 0.25))


def test_fewer_events_than_the_cut(spark):
    log = seq.number_events(events(spark, [("a", 0, 1.0), ("a", 1, 2.0)]), "e", ["i"], "num")
    row = seq.split_means(log, "e", "num", "x", [3]).first()
    assert row.first_3 == 1.5 and row.post_3 is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list(range(12))), st.integers(1, 5))
def test_input_order_and_partitioning_do_not_matter(spark, order, parts):
    rows = [("ab"[i % 2], i, float(i * i % 7)) for i in range(12)]
    def result(rs, n):
        out = seq.annotate(events(spark, rs).repartition(n), "e", ["i"], number="n", running_means={"m": "x"})
        return sorted(tuple(r) for r in out.collect())
    assert result([rows[i] for i in order], parts) == result(rows, 1)


def test_first_and_after_means_give_the_career_mean(spark):
    log = seq.number_events(events(spark, [("ab"[i % 2], i, float(i % 5)) for i in range(40)]), "e", ["i"], "num")
    rows = seq.milestone_means(log, "e", "num", seq.split_columns("x", [7]), [F.count("x").alias("n"), F.avg("x").alias("career")]).collect()
    for r in rows:
        assert (7 * r.first_7 + (r.n - 7) * r.post_7) / r.n == pytest.approx(r.career)


def test_buckets_with_an_open_end_and_ages(spark):
    log = seq.number_events(events(spark), "e", ["i"], "num")
    row = seq.milestone_means(log, "e", "num", {"q1": ("x", 1, 2), "q2": ("x", 3, 4), "rest": ("x", 5, None)}).first()
    assert (row.q1, row.q2, row.rest) == pytest.approx((0.45, 0.6, 0.9))
    df = spark.createDataFrame([(dt.date(2000, 1, 8), dt.date(2000, 1, 1))], "d date, b date")
    age = seq.age_at(df, "d", "b").first()
    assert (age.age_wks, age.age_yrs) == (1.0, 1 / 52)


# ---- oversized groups ------------------------------------------------------


def skewed(spark):
    """A third of the rows in one entity, many of its rows on one day, one far outlier, missing keys, dates and values."""
    i = F.col("id")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.abs(F.hash("id")) % 40).cast("int"))
    return spark.range(12000).select(
        i.alias("row"),
        F.when(i % 3 == 0, 1).when(i % 30 == 1, F.lit(None)).otherwise(F.hash("id") % 200).cast("long").alias("e"),
        F.when(i % 6 == 0, F.lit("2020-01-06").cast("date")).when(i == 3, F.lit("9999-01-01").cast("date"))
        .when(i % 101 == 0, F.lit(None).cast("date")).otherwise(day).alias("d"),
        F.when(i % 7 != 0, (F.hash(i + 5) % 100).cast("double")).alias("x"))


ALL = dict(number="num", size="n", running_sums={"rs": "x"}, running_means={"rm": "x"}, group_sums={"gs": "x"}, group_means={"gm": "x"})


def test_cut_groups_give_the_same_numbers_and_means(spark, small_groups):
    df = skewed(spark)
    plain = seq.annotate(df, "e", ["d", "row"], heavy=None, **ALL)
    cut = seq.annotate(df, "e", ["d", "row"], **ALL)
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_no_cell_is_larger_than_twice_the_limit(spark, small_groups):
    df = skewed(spark)
    levels = skew.hot_cells(df, "e", ["d", "row"])
    sizes = skew.with_cells(df, ["e"], ["d", "row"], levels).groupBy("e", "_cell").count()
    assert sizes.filter("size(_cell) > 0").agg(F.max("count")).first()[0] <= 600


@pytest.mark.parametrize("order", ["ts", "ntz", "text", "real", "flag"])
def test_positions_follow_the_sort_order(spark, small_groups, order):
    i = F.col("id")
    df = spark.range(1500).select(
        i.alias("row"), F.lit(1).alias("e"), F.timestamp_micros(i * 7919 % 1500 * 250000).alias("ts"),
        F.timestamp_micros(i * 7919 % 1500 * 250000).cast("timestamp_ntz").alias("ntz"),
        F.concat(F.chr(F.lit(65) + i % 26), F.lit("é"), i.cast("string")).alias("text"),
        F.when(i % 50 == 0, float("nan")).when(i % 51 == 0, float("inf")).otherwise(i * 7919 % 1500 - 700.5).alias("real"), (i % 2 == 0).alias("flag"))
    plain = {r.row: r.num for r in seq.number_events(df, "e", [order, "row"], "num", heavy=None).collect()}
    cut = {r.row: r.num for r in seq.number_events(df, "e", [order, "row"], "num").collect()}
    assert cut == plain


def test_small_groups_are_not_cut(spark):
    assert skew.hot_cells(skewed(spark), "e", ["d", "row"]) == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("null_safe,unique", [(False, True), (True, True), (False, False)])
def test_joins_around_oversized_keys(spark, small_groups, how, null_safe, unique):
    df = skewed(spark)
    side = df.filter("e IS NULL OR e % 2 = 1").groupBy("e").agg(F.sum("x").alias("total")).withColumnRenamed("e", "k")
    if not unique:
        side = side.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    assert skew.oversized(df, "e").count() > 1
    cut = skew.lookup_join(df, side, {"e": "k"}, how, null_safe, where=F.col("x") > 0, unique=unique)
    plain = skew.lookup_join(df, side, {"e": "k"}, how, null_safe, heavy=None, where=F.col("x") > 0)
    assert cut.columns == plain.columns and sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_extreme_rows_of_oversized_groups(spark, small_groups):
    df = skewed(spark).filter("x IS NOT NULL")
    best = {r.e: r.m for r in df.groupBy("e").agg(F.max("x").alias("m")).collect()}
    want = {r.row for r in df.collect() if r.x == best[r.e]}
    assert {r.row for r in seq.arg_max_rows(df, "e", "x").collect()} == want


def test_sizes_may_be_counted_elsewhere(spark, small_groups):
    df = skewed(spark)
    assert skew.hot_cells(df, "e", ["d", "row"], heavy=skew.oversized(df.select("e").filter("e > 100"), "e")) == []


# ---- one row per entity, group ends ----------------------------------------


def test_latest_attributes(spark):
    df = spark.createDataFrame([("a", 1, "old", 1), ("a", 2, "new", 2), ("b", 5, "only", 3)], "e string, i int, name string, v int")
    got = {r.e: (r.name, r.v) for r in seq.latest_attributes(df, "e", ["i"], ["name", "v"]).collect()}
    assert got == {"a": ("new", 2), "b": ("only", 3)}


def test_null_policy(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "e string, x double")
    assert seq.workload(df, "e", {"m": "x"}, {"lo": "x"}).first()[1:] == (1.0, 1.0)
    assert seq.workload(df, "e", {"m": "x"}, {"lo": "x"}, "propagate").first()[1:] == (None, None)
    with pytest.raises(ValueError):
        seq.workload(df, "e", {"m": "x"}, null_policy="drop")


def test_tail_pattern(spark):
    games = {"g1": [(4, True), (4, True)], "g2": [(4, True), (0, True)], "g3": [(0, True), (4, True), (4, True), (0, False)], "g4": [(4, True)]}
    rows = [(g, i, h, pa) for g, plays in games.items() for i, (h, pa) in enumerate(plays)]
    df = spark.createDataFrame(rows, "g string, i int, hit int, pa boolean")
    got = seq.tail_matches(df, "g", ["i"], 2, F.col("hit") == 4, F.col("pa"))
    assert sorted({r.g for r in got.collect()}) == ["g1", "g3"]
    assert got.count() == 4


def test_extreme_rows_keep_ties_and_drop_groups_with_missing_values(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("b", 4, 1.0), ("b", 5, None), (None, 6, 7.0)], "k string, i int, v double")
    assert sorted(r.i for r in seq.arg_max_rows(df, "k", "v").collect()) == [1, 2, 6]
    assert sorted(r.i for r in seq.arg_max_rows(df, "k", "v", "skip").collect()) == [1, 2, 4, 6]
    assert sorted(r.i for r in seq.arg_min_rows(df, "k", "v").collect()) == [3, 6]


def test_group_totals_include_missing_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, x double")
    assert sorted(map(tuple, seq.group_mean(seq.group_total(df, "k"), "k", "x").collect()), key=str) == [
        ("a", 1.0, 2, 2.0), ("a", 3.0, 2, 2.0), (None, 5.0, 1, 5.0)]


def test_cohort_is_strict_and_drops_missing_dates(spark):
    df = spark.createDataFrame([(dt.date(1990, 4, 8),), (dt.date(1990, 4, 9),), (None,), (dt.date(2011, 1, 1),)], "d date")
    assert [r.d for r in seq.cohort(df, "d", "1990-04-08", "2011-01-01").collect()] == [dt.date(1990, 4, 9)]


@pytest.mark.parametrize("order", [
    "concat('Customer#', lpad(id, 9, '0'))", "pow(2.0D, id % 600)", "array(1, int(id))", "struct('a' AS p, id AS q)"])
def test_any_order_is_cut_evenly(spark, small_groups, order):
    df = spark.range(6000).select(F.lit(1).alias("e"), F.lit("2001-01-01").cast("date").alias("d"), F.expr(order).alias("o"), "id").repartition(5)
    levels = skew.hot_cells(df, "e", ["d", "o", "id"])
    cells = skew.with_cells(df, ["e"], ["d", "o", "id"], levels).groupBy("_cell").count().collect()
    assert len(cells) >= 20 and max(r["count"] for r in cells) <= 600
    got = seq.number_events(df, "e", ["d", "o", "id"], "num").select("id", "num").collect()
    want = {r.id: k for k, r in enumerate(df.select("o", "id").orderBy("o", "id").collect(), 1)}
    assert {r.id: r.num for r in got} == want


def test_a_thousand_cells(spark):
    """The same rows, and a plan in which no row looks through the bounds of the cells."""
    spark.conf.set(skew.MAX_GROUP_ROWS_CONF, "40")
    try:
        df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("e"), (F.col("id") * 7919 % 20_011).alias("o"), (F.col("id") % 97).alias("x"), "id").repartition(4)
        levels = skew.hot_cells(df, "e", ["o"])
        assert skew.with_cells(df, ["e"], ["o"], levels).select("_cell").distinct().count() >= 900
        cut = seq.annotate(df, "e", ["o"], number="n", size="s", running_means={"m": "x"}, group_sums={"g": "x"})
        assert "lambda" not in cut._jdf.queryExecution().executedPlan().toString()
        plain = seq.annotate(df, "e", ["o"], number="n", size="s", running_means={"m": "x"}, group_sums={"g": "x"}, heavy=None)
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset(skew.MAX_GROUP_ROWS_CONF)


@pytest.mark.parametrize("kind", ["int", "date", "string", "boolean", "decimal(9,2)"])
def test_joins_of_rows_without_a_key(spark, kind):
    """Nine rows in ten have no key: none of them matches, and they do not meet in one task."""
    key = F.when(F.col("id") % 10 == 0, F.date_add(F.lit("2001-01-01"), (F.col("id") % 70).cast("int")) if kind == "date" else
                 (F.col("id") % 20 == 0) if kind == "boolean" else (F.col("id") % 70).cast(kind))
    df = spark.range(2000).select("id", key.alias("k"))
    side = df.filter("k is not null").groupBy("k").agg(F.max("id").alias("top")).unionByName(spark.range(1).select(F.lit(None).cast(kind).alias("k"), F.lit(-1).cast("long").alias("top")))
    side = side.withColumnRenamed("k", "sk")
    got = {r.id: r.top for r in skew.join_known(df, side, "k", "sk").collect()}
    best = {r.sk: r.top for r in side.collect()}
    assert got == {r.id: None if r.k is None else best[r.k] for r in df.collect()}
    assert re.search(r"Exchange hashpartitioning\(k#\d+, _spread#", skew.join_known(df, side.hint("merge"), "k", "sk")._jdf.queryExecution().executedPlan().toString())


def test_long_group_ends_are_limited_in_parts(spark):
    """Beyond the number of rows up to which Spark limits groups itself, each part of a group is limited first."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 40_009).alias("o"), "id").repartition(4)
    ends = seq.tail_n(df, "g", ["o"], 5_000)
    text = ends._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [") == 2 and re.search(r"hashpartitioning\(g#\d+L?, _part", text)
    rows = df.collect()
    want = {r.id for g in (0, 1) for r in sorted((r for r in rows if r.g == g), key=lambda r: r.o)[-5_000:]}
    assert {r.id for r in ends.collect()} == want and ends.columns == df.columns
