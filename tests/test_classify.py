import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from careerspark.config import GRADE_LEVELS, GRADES
from careerspark.operators import classify as c


def values(spark, vs, ddl="v double"):
    return spark.createDataFrame([(v,) for v in vs], ddl)


def test_role_ratio(spark):
    cases = {"p1": (100, None), "p2": (None, 50), "p3": (10, 100), "p4": (80, 100), "p5": (425, 100), "p6": (426, 100), "p7": (4254, 1000)}
    a = spark.createDataFrame([(k, x) for k, (x, _) in cases.items() if x], "id string, n_bat long")
    b = spark.createDataFrame([(k, y) for k, (_, y) in cases.items() if y], "id string, n_pit long")
    roles = c.role_ratio(a, b, "id", "n_bat", "n_pit")
    got = {r.id: r.role for r in roles.collect()}
    assert [got[k] for k in cases] == ["Batter", "Pitcher", "Pitcher", "Two-Way", "Two-Way", "Batter", "Two-Way"]
    flags = {r.id: r.out for r in c.role_flags(roles, "id", "n_bat", "out", "Pitcher").collect()}
    assert flags == {"p1": False, "p3": True, "p4": False, "p5": False, "p6": False, "p7": False}


def test_flags_remove_out_of_role_rows(spark):
    log = spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 3), ("p9", 4)], "id string, i int")
    flags = spark.createDataFrame([("p1", False), ("p2", True)], "id string, out boolean")
    assert sorted(r.i for r in c.drop_out_of_role(c.attach_flags(log, flags, "id"), "out").collect()) == [1, 2]


def test_grades(spark):
    higher = [.400, .3994, .3696, .340, .320, .310, .291, .290, None]
    got = [r.g for r in values(spark, higher).select(c.grade("v").alias("g")).collect()]
    assert got == ["Elite", "Great", "Great", "Good", "Average", "Below Average", "Poor", "Awful", None]
    lower = [.290, .291, .310, .320, .340, .370, .400]
    got = [r.g for r in values(spark, lower).select(c.inverted_grade("v").alias("g")).collect()]
    assert got == ["Elite", "Great", "Good", "Average", "Below Average", "Poor", "Awful"]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 2), min_size=20, max_size=60))
def test_bands_leave_no_gap(spark, vs):
    rows = values(spark, vs).select(c.grade("v").alias("a"), c.inverted_grade("v").alias("b")).collect()
    for r in rows:
        assert GRADES.index(r.a) + GRADES.index(r.b) == len(GRADES) - 1


def test_gates_and_scope(spark):
    df = spark.createDataFrame([(149, .410, True), (150, .410, True), (150, .410, False), (150, None, True)], "n int, v double, s boolean")
    got = [r.g for r in df.select(c.grade("v", total="n", min_total=150, scope=F.col("s")).alias("g")).collect()]
    assert got == ["DNQ", "Elite", None, None]


def test_simple_grades_and_scores(spark):
    df = values(spark, [*GRADE_LEVELS, None], "g string")
    rows = df.select(c.simple_grade("g").alias("first"), c.simple_grade("g", "Bad").alias("post"), c.grade_score("g").alias("score")).collect()
    assert [r.first for r in rows] == ["Good", "Good", "Good", "Average", "Bad", "Bad", "Bad", "DNQ", None]
    assert [r.post for r in rows][-2:] == ["Bad", None]
    assert [r.score for r in rows] == [8, 7, 6, 5, 4, 3, 2, 1, None]


def test_status(spark):
    df = values(spark, [dt.date(2020, 9, 29), dt.date(2020, 9, 28), dt.date(2020, 9, 27)], "d date")
    assert [r.status for r in c.status_at(df, "d", "2020-09-28").collect()] == ["ACTIVE", None, "INACTIVE"]


def test_workload_class(spark):
    df = spark.createDataFrame([(70., 1, 3.), (40., 1, 3.), (55., 2, 3.), (55., 1, 5.6), (55., 1, 3.), (None, 1, 3.)], "a double, b int, c double")
    got = [r.workload_class for r in c.workload_class(df, "a", "b", "c").collect()]
    assert got == ["STARTER", "RELIEVER", "RELIEVER", "RELIEVER", "OTHER", "OTHER"]


def test_rank_groups(spark):
    df = values(spark, [1, 25, 26, 50, 51, 75, 76, 100, None, 101], "r int")
    rows = df.select(c.rank_group("r").alias("g"), c.ranked_flag("r").alias("f")).collect()
    assert [r.g for r in rows] == ["1 - 25"] * 2 + ["26 - 50"] * 2 + ["51 - 75"] * 2 + ["76 - 100"] * 2 + ["Unranked", None]
    assert [r.f for r in rows] == ["Y"] * 8 + ["N", None]


@pytest.mark.parametrize("value,text", [(.35, ".350"), (-.012, "-.012"), (1.25, "1.250"), (0.0, ".000"), (None, None)])
def test_trimmed_number(spark, value, text):
    from careerspark.functions.scalars import trimmed_number
    assert values(spark, [value]).select(trimmed_number("v").alias("t")).first().t == text


def test_scalars(spark):
    from careerspark.functions import scalars as s
    row = spark.range(1).select(
        s.replace_first(F.lit("aXbXc"), "X", "-").alias("a"), s.replace_first(F.lit("abc"), "X", "-").alias("b"),
        s.full_name(F.lit("Al"), F.lit(None).cast("string")).alias("c"), s.percent_label(F.lit(0.4567)).alias("d"),
        s.percent_label(F.lit(0.01), 0.035).alias("e"), s.if_else(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)).alias("f"),
        s.not_in(F.lit(None).cast("string"), ["x"]).alias("g"), s.round_half_up(F.lit(0.0125), 3).alias("h"),
        s.round_half_even(F.lit(2.5)).alias("i"), s.ratio(F.lit(1), F.lit(0)).alias("j"), s.title_case(F.lit("RED SOX")).alias("k"),
        s.mirrored(F.lit(3), F.lit(True)).alias("l"), s.prefix(F.lit("S78"), 1).alias("m"), s.year_date(F.lit(1999)).alias("n")).first()
    assert row[:13] == ("a-bXc", "abc", "Al", "46%", None, None, True, 0.013, 2.0, None, "Red Sox", -3, "S")
    assert row.n == dt.date(1999, 1, 1)
