"""Data checks on the baseball inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CALIBRATION_INNINGS, MAX_RANK_USES
from ..functions.scalars import date_lit, full_name
from ..operators.profiling import (ambiguous_keys, duplicate_keys, duplicate_rows, gap_outliers, oversized_groups,
                                   prefix_counts, range_violations, ranges, violations)
from ..operators.report import calibrate

# Weight column of each hit value.
WEIGHT_BY_HIT = {1: "w1B", 2: "w2B", 3: "w3B", 4: "wHR"}


def five_run_events(plays: DataFrame) -> DataFrame:
    """Four runs are the most that one event can score."""
    return violations(plays, F.col("EVENT_RUNS") == 5)


def weight_ranges(weights: DataFrame) -> DataFrame:
    seasons = F.col("Season").between(date_lit("1990-01-01"), date_lit("2020-01-01"))
    return ranges(weights, ["wBB", "wHBP", "w1B", "w2B", "w3B", "wHR"], where=seasons)


def measure_ranges(plays: DataFrame) -> DataFrame:
    return ranges(plays, ["EVENT_WOBA"], ["HIT_VAL"], where=F.col("EVENT_WOBA") != 0)


def measure_violations(plays: DataFrame, weights: DataFrame) -> DataFrame:
    """Hit values whose observed measure leaves the range of the published weights. Walks and hits by pitch have
    hit value 0, so that code is allowed the range of both."""
    row = weight_ranges(weights)
    codes = [F.struct(F.lit(0).alias("HIT_VAL"), F.least("min_wBB", "min_wHBP").alias("allowed_low"),
                      F.greatest("max_wBB", "max_wHBP").alias("allowed_high"))]
    codes += [F.struct(F.lit(hit).alias("HIT_VAL"), F.col(f"min_{w}").alias("allowed_low"), F.col(f"max_{w}").alias("allowed_high"))
              for hit, w in WEIGHT_BY_HIT.items()]
    allowed = row.select(F.inline(F.array(*codes)))
    return range_violations(measure_ranges(plays), allowed, ["HIT_VAL"], "min_EVENT_WOBA", "max_EVENT_WOBA")


def event_codes(plays: DataFrame, length: int = 1, first: str | None = None) -> DataFrame:
    """Event prefixes by hit value; ``first`` limits to events that begin with it."""
    where = None if first is None else F.col("EVENT_TX").startswith(first)
    return prefix_counts(plays, "EVENT_TX", length, ["HIT_VAL"], where)


def same_names(people: DataFrame) -> DataFrame:
    return duplicate_keys(people.withColumn("NAME", full_name("NICKNAME", "LAST")), ["NAME"])


def ranking_duplicates(rankings: DataFrame) -> DataFrame:
    return duplicate_rows(rankings)


def overused_ranks(rankings: DataFrame) -> DataFrame:
    """Ranks given more often than there are yearly lists."""
    return oversized_groups(rankings.distinct(), ["PROSPECT_RANK"], MAX_RANK_USES)


def names_in_several_teams(rankings: DataFrame) -> DataFrame:
    return ambiguous_keys(rankings.filter(F.col("ID").isNull()), "PLAYER_NAME", "TEAM")


def implausible_gaps(rankings: DataFrame, lo: float, hi: float) -> DataFrame:
    return gap_outliers(rankings, "RANK_DEBUT_DATEDIFF_WKS", lo, hi)


def batters_faced_per_innings(leaderboard: DataFrame) -> DataFrame:
    """Batters faced per inning, and what 50 and 200 innings amount to."""
    return calibrate(leaderboard, "TBF", "IP", {f"per_{u}_innings": u for u in CALIBRATION_INNINGS}, rate="per_inning")
