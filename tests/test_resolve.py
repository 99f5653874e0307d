import datetime as dt

import pytest
from pyspark.sql import functions as F

from careerspark.operators import resolve as r
from careerspark.operators.profiling import duplicate_keys, unresolved
from careerspark.operators.report import debut_rate
from careerspark.operators.resolve import Correction, Step
from careerspark.operators.skew import MAX_GROUP_ROWS_CONF


def rankings(spark, rows):
    return spark.createDataFrame(rows, "name string, id string")


def people(spark, rows):
    return spark.createDataFrame(rows, "pname string, pid string, debut date")


def test_alias_matches_whole_names_only(spark):
    df = rankings(spark, [("Shawn Gree", None), ("Shawn Green", None), ("Other", None)])
    got = [x.name for x in r.apply_aliases(df, {"Shawn Gree": "Shawn Green"}, "name").collect()]
    assert sorted(got) == ["Other", "Shawn Green", "Shawn Green"]


def test_cascade_order_and_aliases(spark):
    early, late = dt.date(1995, 1, 1), dt.date(2022, 1, 1)
    first = people(spark, [("Ann", "ann1", early)])
    second = people(spark, [("Ann", "ann2", early), ("Bob", "bob2", early)])
    third = people(spark, [("Robert", "rob3", late), ("Cy", "cy3", early)])
    df = rankings(spark, [("Ann", None), ("Bob", "given"), ("Bob", None), ("Bobby", None), ("Cy", None), ("Dan", None)])
    steps = [Step(first, "pname", "pid"), Step(second, "pname", "pid"),
             Step(third, "pname", "pid", F.col("debut") > F.lit("2021-01-01").cast("date"), aliased=True)]
    out = r.resolve_cascade(df, steps, name="name", id="id", aliases={"Bobby": "Robert"})
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("Ann", "ann1", 1), ("Bob", "given", 0), ("Bob", "bob2", 2), ("Robert", "rob3", 3), ("Cy", None, None), ("Dan", None, None)], key=str)
    assert {x.name: x.n for x in unresolved(out, "id", "name").collect()} == {"Cy": 1, "Dan": 1}


def test_ambiguous_names_keep_every_candidate(spark):
    source = people(spark, [("Ann", "a1", None), ("Ann", "a2", None), ("Ann", "a2", None)])
    df = rankings(spark, [("Ann", None)])
    out = r.resolve_cascade(df, [Step(source, "pname", "pid")], name="name", id="id")
    assert sorted(x.id for x in out.collect()) == ["a1", "a2"]
    assert [x.n for x in duplicate_keys(out, ["name"]).collect()] == [2]
    first = r.resolve_cascade(df, [Step(source, "pname", "pid")], name="name", id="id", on_ambiguous="first")
    assert [x.id for x in first.collect()] == ["a1"]
    with pytest.raises(ValueError):
        r.resolve_cascade(df, [], name="name", id="id", on_ambiguous="any")


def test_single_step_fills_only_missing_ids(spark):
    out = r.resolve_step(rankings(spark, [("Ann", None), ("Ann", "x")]), people(spark, [("Ann", "a1", None)]), "name", "id", "pname", "pid")
    assert sorted(x.id for x in out.collect()) == ["a1", "x"]


def test_corrections(spark):
    df = spark.createDataFrame([("a", "n1", 1.0), ("a", "n1", 7.0), ("b", "n2", 1.0), ("c", "n3", 1.0), (None, "n4", 1.0), ("e", "n5", None)], "id string, name string, pos double")
    rules = [Correction({"id": "a", "pos": 1.0}, {"id": "a2"}), Correction({"id": "a"}, {"name": "N1"}), Correction({"id": "b"}, {"id": None}),
             Correction({"id": "c"}, drop_row=True), Correction({"name": "n4"}, {"id": "d", "name": "N4"}), Correction({"id": "a"}, {"name": "never"})]
    assert sorted(map(tuple, r.apply_corrections(df, rules).collect()), key=str) == sorted([
        ("a2", "n1", 1.0), ("a", "N1", 7.0), (None, "n2", 1.0), ("d", "N4", 1.0), ("e", "n5", None)], key=str)
    assert r.apply_corrections(df, []) is df


def test_rank_in_force_at_debut(spark):
    debut = dt.date(2005, 6, 1)
    def gaps(years, id="p"):
        df = spark.createDataFrame([(id, dt.date(y, 1, 1), debut) for y in years], "id string, year date, debut date")
        return r.rank_gap(df, "year", "debut", "gap")
    g = gaps([2004, 2005, 2006])
    assert [x.gap for x in g.orderBy("year").collect()] == pytest.approx([-517 / 7, -151 / 7, 214 / 7])
    latest = r.latest_ranking(g, "id", "gap")
    assert [x.year for x in latest.collect()] == [dt.date(2006, 1, 1)]
    assert r.latest_ranking(gaps([2004]), "id", "gap").count() == 0   # fell off the list before the debut
    assert r.latest_ranking(gaps([2005], id=None), "id", "gap").count() == 0


def test_refresh(spark):
    d = dt.date
    rows = [("Ann", None, d(2010, 1, 1), None, None), ("Old", None, d(2001, 1, 1), None, None), ("Twin", None, d(2010, 1, 1), None, None),
            ("Late", None, d(2015, 1, 1), None, None), ("Has", "h", d(2010, 1, 1), d(2011, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "name string, id string, year date, debut date, gap double")
    update = spark.createDataFrame([(n, n.lower(), day) for n, day in [
        ("Ann", d(2020, 7, 1)), ("Old", d(2020, 7, 1)), ("Twin", d(2020, 7, 1)), ("Late", d(2021, 5, 1))]], "uname string, uid string, uday date")
    out = r.refresh_ids(df, update, name="name", id="id", year="year", debut="debut", gap="gap", update_name="uname",
                        update_id="uid", update_debut="uday", exclude=["Twin"])
    got = {x.name: (x.id, x.debut, x.gap) for x in out.collect()}
    assert got["Ann"] == ("ann", d(2020, 7, 1), pytest.approx((d(2010, 1, 1) - d(2020, 7, 1)).days / 7))
    assert got["Old"] == (None, None, None) and got["Twin"] == (None, None, None)
    assert got["Late"] == ("late", d(2021, 5, 1), None)
    assert got["Has"][2] == pytest.approx(-365 / 7)


def test_debut_rate(spark):
    d = dt.date
    rows = [("Ann", "a", d(2001, 1, 1), 10, d(2001, 5, 1), -120 / 7), ("Bob", None, d(2000, 1, 1), 20, None, None),
            ("Bob", None, d(2002, 1, 1), 30, None, None), ("Cy", None, d(2012, 1, 1), 5, None, None)]
    df = spark.createDataFrame(rows, "name string, id string, year date, rank int, debut date, gap double")
    out = debut_rate(df, name="name", entity="id", year="year", rank="rank", debut="debut", gap="gap")
    got = {(x.rank_group, x.debuted): (x.n, x.label) for x in out.collect()}
    assert got["1 - 25", "Yes"] == (1, "100% (1)") and got["26 - 50", "No"] == (1, "100% (1)")   # Bob counts with his last list
    assert got["Total", "Total"] == (2, "100% (2)") and got["51 - 75", "Yes"] == (0, "- (0)")


@pytest.mark.parametrize("ambiguous", ["all", "first"])
def test_names_listed_often_resolve_the_same(spark, ambiguous):
    """With every name on more than three rows taken for oversized, missing names among them."""
    names = ["Ann"] * 9 + ["Bob"] * 2 + [None] * 7 + ["Bobby"] * 5 + ["Zed"] * 6
    df = rankings(spark, [(n, "given" if i % 4 == 0 else None) for i, n in enumerate(names)])
    source = people(spark, [("Ann", "a1", None), ("Ann", "a2", None), ("Bob", "b1", None), ("Robert", "r1", None), (None, "none", None)])
    steps = [Step(source, "pname", "pid"), Step(source, "pname", "pid", aliased=True)]

    def result(heavy):
        aliases = spark.createDataFrame([("Bobby", "Robert")], "name string, canonical_name string")
        out = r.resolve_cascade(df, steps, name="name", id="id", aliases=aliases, on_ambiguous=ambiguous, heavy=heavy)
        return sorted(map(str, out.collect()))

    spark.conf.set(MAX_GROUP_ROWS_CONF, "3")
    try:
        assert result("auto") == result(None)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)
