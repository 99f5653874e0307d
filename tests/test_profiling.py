import statistics

import pytest
from pyspark.sql import functions as F

from careerspark.operators import profiling as p


@pytest.mark.parametrize("exact", [False, True])
def test_profile(spark, exact):
    df = spark.createDataFrame([(1, "a"), (2, None), (4, ""), (None, "long")], "n int, s string")
    rows = {r.column: r for r in p.profile(df, exact=exact).collect()}
    n, s = rows["n"], rows["s"]
    assert (n.n_rows, n.n_missing, n.complete_rate, n.n_distinct) == (4, 1, .75, 3)
    assert n["mean"] == pytest.approx(7 / 3) and n.sd == pytest.approx(statistics.stdev([1, 2, 4])) and (n.p0, n.p50, n.p100) == (1, 2, 4)
    assert (s.min_text, s.max_text, s.min_length, s.max_length, s.n_empty, s.p50) == ("", "long", 0, 4, 1, None)


def test_ranges_and_violations(spark):
    df = spark.createDataFrame([(0, 0.0), (1, .8), (1, .95), (4, 2.5)], "hit int, x double")
    seen = p.ranges(df, ["x"], ["hit"], F.col("x") != 0)
    assert {r.hit: (r.min_x, r.max_x) for r in seen.collect()} == {1: (.8, .95), 4: (2.5, 2.5)}
    allowed = spark.createDataFrame([(1, .8, .95), (4, 1.9, 2.1)], "hit int, allowed_low double, allowed_high double")
    assert [r.hit for r in p.range_violations(seen, allowed, ["hit"], "min_x", "max_x").collect()] == [4]
    assert p.range_violations(seen.filter("hit = 1"), allowed, ["hit"], "min_x", "max_x").count() == 0
    assert p.violations(df, F.col("hit") == 4).count() == 1


def test_counts(spark):
    df = spark.createDataFrame([("S7", 1), ("S8", 1), ("W", 0), (None, 0)], "t string, h int")
    assert {(r.prefix, r.h): r.n for r in p.prefix_counts(df, "t", 1, ["h"]).collect()} == {("S", 1): 2, ("W", 0): 1, (None, 0): 1}
    assert {r.prefix for r in p.prefix_counts(df, "t", 2, where=F.col("t").startswith("S")).collect()} == {"S7", "S8"}
    assert {r.h: r.n for r in p.value_counts(df, "h").collect()} == {1: 2, 0: 2}


def test_duplicates_and_group_sizes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3), (None, 3)], "k string, v int")
    assert {(r.k, r.v): r.n_copies for r in p.duplicate_rows(df).collect()} == {("a", 1): 2, (None, 3): 2}
    assert {r.k: r.n for r in p.duplicate_keys(df, ["k"]).collect()} == {"a": 3, None: 2}
    big = p.oversized_groups(df, ["k"], 2)
    assert big.count() == 3 and {r.group_size for r in big.collect()} == {3}
    assert {(r.k, r.v) for r in p.ambiguous_keys(df, "k", "v").collect()} == {("a", 1), ("a", 2)}


def test_inspect_and_gaps(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 500.0), ("b", 2, None)], "k string, i int, gap double")
    assert [r.i for r in p.inspect(df, "k", "a", ["i"], ["i"]).collect()] == [1, 3]
    assert [r.i for r in p.gap_outliers(df, "gap", -10, 100).collect()] == [1]


def test_exact_profile_scans_once_and_shuffles_once(spark, tmp_path):
    spark.range(300).select(F.col("id"), (F.col("id") % 7).alias("a"), (F.col("id") / 3).alias("x"), F.col("id").cast("string").alias("s")).write.parquet(str(tmp_path / "t"))
    text = p.value_table(spark.read.parquet(str(tmp_path / "t")), ["id", "a", "x", "s"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_exact_profile_of_odd_values(spark):
    df = spark.sql("""SELECT * FROM VALUES (0.0D, 9007199254740993L, date'2001-02-03', 1.50BD, true), (-0.0D, 9007199254740992L, null, 1.5BD, false),
        (double('NaN'), null, date'1999-01-01', null, true), (null, 5L, null, 2BD, null) AS t(d, big, day, money, flag)""").withColumn("a.b", F.col("big"))
    rows = {r.column: r for r in p.profile(df, exact=True).collect()}
    assert rows["d"].n_distinct == 2 and rows["big"].n_distinct == 3 and rows["money"].n_distinct == 2 and rows["a.b"].n_distinct == 3
    assert (rows["day"].min_text, rows["day"].n_missing, rows["flag"].max_text) == ("1999-01-01", 2, "true")
    empty = {r.column: r for r in p.profile(df.filter("false"), exact=True).collect()}
    assert (empty["d"].n_rows, empty["d"].n_distinct, empty["d"].p50) == (0, 0, None)


def test_sketches_of_parts_add_up(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("part"), (F.col("id") * 7919 % 60_013).alias("v"), F.when(F.col("id") % 3 > 0, (F.col("id") % 1000).cast("string")).alias("s"))
    whole = {r.column: r for r in p.profile_of(p.sketches(df, ["v", "s"]), errors=True).collect()}
    parts = p.merged(p.sketches(df, ["v", "s"], ["part"]))
    assert p.errors_held(df, p.profile_of(parts, errors=True), ["v", "s"]).filter("not distinct_within or not coalesce(quantiles_within, true)").count() == 0
    for r in p.profile_of(parts).collect():
        w = whole[r.column]
        assert (r.n_rows, r.n_missing, r.min_text, r.max_length) == (w.n_rows, w.n_missing, w.min_text, w.max_length)
        assert r.sd == (pytest.approx(w.sd) if w.sd else None) and r["mean"] == (pytest.approx(w["mean"]) if w["mean"] else None)
    assert whole["v"].rank_error == p.RANK_ERROR and whole["s"].rank_error is None
