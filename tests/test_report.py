import math

import pytest
from pyspark.sql import functions as F

from careerspark.operators import report as r
from careerspark.operators import shape


def pairs(spark):
    return spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y")], "r string, c string")


LEVELS = {"r": ["A", "B"], "c": ["x", "y"]}


def test_crosstab_totals_and_row_shares(spark):
    ct = r.row_percent(r.add_totals(r.crosstab(pairs(spark), "r", "c", LEVELS), "r", "c"), "r", "c")
    got = {(x.r, x.c): (x.n, x.pct) for x in ct.collect()}
    assert got == {
        ("A", "x"): (2, 2 / 3), ("A", "y"): (1, 1 / 3), ("A", "Total"): (3, None), ("B", "x"): (0, None), ("B", "y"): (0, None),
        ("B", "Total"): (0, None), ("Total", "x"): (2, 2 / 3), ("Total", "y"): (1, 1 / 3), ("Total", "Total"): (3, None)}


def test_missing_categories_stay_in_the_crosstab(spark):
    df = pairs(spark).unionByName(spark.createDataFrame([(None, "x"), ("Z", "y")], "r string, c string"))
    ct = r.crosstab(df, "r", "c", LEVELS)
    assert ct.agg(F.sum("n")).first()[0] == df.count()
    totals = r.add_totals(ct, "r", "c")
    assert totals.filter("r = 'Total' AND c = 'Total'").first().n == 5
    assert totals.filter("r IS NULL AND c = 'Total'").first().n == 1


def test_slices_and_wide_form(spark):
    df = pairs(spark).withColumn("s", F.lit("one"))
    ct = r.crosstab3(df, "r", "c", "s", {"s": ["one", "two"], **LEVELS})
    assert ct.count() == 8
    wide = {x.r: (x.x, x.y) for x in r.wide(r.slice_of(ct, "s", "one"), "r", "c", ["x", "y"]).collect()}
    assert wide == {"A": (2, 1), "B": (0, 0)}


def test_shares_after_completion(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("b", "y", 1)], "g string, h string, n long")
    full = shape.complete_grid(counts, {"g": ["a", "b"], "h": ["x", "y"]}, {"n": 0})
    got = {(x.g, x.h): x.share for x in shape.share(full, "n").collect()}
    assert got == {("a", "x"): .75, ("b", "y"): .25, ("a", "y"): 0.0, ("b", "x"): 0.0}
    by = {(x.g, x.h): x.share for x in shape.share(full, "n", by=["g"]).collect()}
    assert by == {("a", "x"): 1.0, ("a", "y"): 0.0, ("b", "x"): 0.0, ("b", "y"): 1.0}


def test_rate_table(spark):
    got = {(x.r, x.c): x.label for x in r.rate_table(pairs(spark), "r", "c", LEVELS).collect()}
    assert got["A", "x"] == "67% (2)" and got["Total", "Total"] == "100% (3)" and got["B", "x"] == "- (0)"


def test_before_after_and_retention(spark):
    df = spark.createDataFrame([("g", .3, .35, 700), ("g", .4, None, 1900), ("h", .2, .2, 10)], "g string, a double, b double, n int")
    row = r.before_after_summary(df, "g", "a", "b", F.col("n") >= 600).first()
    assert tuple(row) == ("g", .35, .35, 0.0, 2)
    assert [tuple(x) for x in r.retention(df, "g", "n", 600, 1800).collect()] == [("g", 2, 1, 50.0)]


def test_band_and_transition_share(spark):
    levels = ["Good", "Average", "Bad"]
    df = spark.createDataFrame([("g", "Good", "Bad"), ("g", "Bad", "Average"), ("g", "Bad", "Bad"), ("g", "Bad", None)], "g string, a string, b string")
    assert r.band_share(df, "g", "a", levels, "Average").first().share == .25
    ct = r.crosstab3(df, "a", "b", "g")
    row = r.transition_share(ct, "g", "a", "b", levels, "Bad", "Average").first()
    assert (row.n, row.n_reach, row.share) == (3, 1, 1 / 3)


def test_top_k_and_its_summary(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(20)], "id int, v double")
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    assert [x.id for x in r.top_k(df, order, 3, ["id"]).collect()] == [3, 7, 11]
    row = r.top_k_summary(df, order, 4, [F.sum("id").alias("s"), r.median("id").alias("m"), F.avg("id").alias("a")]).first()
    assert (row.s, row.m, row.a) == (36, 9.0, 9.0)


def test_one_row_results(spark):
    df = spark.createDataFrame([(430, 100.0), (430, 100.0)], "tbf long, ip double")
    row = r.calibrate(df, "tbf", "ip", {"fifty": 50, "two_hundred": 200}).first()
    assert (row.tbf_sum, row.rate, row.fifty, row.two_hundred) == (860, 4.3, 215.0, 860.0)
    games = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "g string")
    row = r.occurrence_rate(games, games.filter("g = 'a'"), "g").first()
    assert (row.n_total, row.n_hits, row.one_in) == (3, 1, 3.0) and math.isclose(row.pct, 100 / 3)
    assert r.occurrence_rate(games, games.filter("g = 'z'"), "g").first().one_in is None


def test_relocate(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert shape.relocate(df, "a", after="c").columns == ["b", "c", "a", "d"]
    assert shape.relocate(df, "c:d", before="b").columns == ["a", "c", "d", "b"]
    assert shape.relocate(df, ["d"]).columns == ["d", "a", "b", "c"]
    assert shape.select_at(df, [0, 3]).columns == ["a", "d"] and shape.drop_at(df, [0, 3]).columns == ["b", "c"]
    with pytest.raises(ValueError):
        shape.relocate(df, "a", after="b", before="c")
    with pytest.raises(ValueError):
        shape.relocate(df, "a:c", after="b")
