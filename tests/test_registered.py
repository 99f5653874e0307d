"""Every registered query agrees with its SQL, and the plans have the shape they should have."""

import pytest

import __spark_entry__ as entry
from careerspark.operators.sequence import group_total
from careerspark.operators.skew import MAX_GROUP_ROWS_CONF
from oracle import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: q.run for name, q in entry.REGISTRY.items()}
SQL = {name: q.sql for name, q in entry.REGISTRY.items() if q.sql is not None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, QUERIES[name], SQL[name], FOLDER)[:3] == []
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["annotated_supplier_log", "number_two_roles", "role_flags", "crosstab_row_percent", "kde_career",
                                  "resolve_cascade", "refresh_ids", "debut_rate", "profile", "published_pitchers"])
def test_query_with_groups_cut(spark, name):
    """With every group over 20 rows taken for oversized, the rows are the same."""
    spark.conf.set(MAX_GROUP_ROWS_CONF, "20")
    try:
        assert compare(spark, QUERIES[name], SQL[name], FOLDER)[:3] == []
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stage_round_trip", "csv_round_trip"}))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name, scans", [("group_total", 2), ("group_mean", 2), ("latest_ranking", 1), ("attach_ranking", 2),
                                         ("debut_rate", 2), ("rank_gap", 1)])
def test_tables_are_not_read_again(spark, name, scans):
    assert plan(spark, name).count("FileScan") <= scans


def test_group_sizes_need_no_job_of_their_own(spark):
    spark.sparkContext.setJobGroup("planning", "planning")
    events = spark.read.schema("user_id long").parquet("/root/testdata/sf0.001/events.parquet")
    group_total(events, "user_id")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_milestones_shuffle_the_log_once(spark):
    text = plan(spark, "split_means")
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Window [") == 1


def test_group_ends_are_limited_before_the_shuffle(spark):
    assert "row_number(), 2, Partial" in plan(spark, "tail_n")


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_k")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "ranges")
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double,l_shipdate" in text
