"""Roles, classes, rank groups and graded bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (GRADE_SCORES, HIGHER_IS_BETTER, LOWER_IS_BETTER, RANK_EDGES, RELIEVER_MEAN_INNING,
                      RELIEVER_PITCHES, ROLE_HIGH, ROLE_LOW, STARTER_PITCHES)
from ..functions.scalars import as_col, round_half_up, thousandths
from .skew import AUTO, lookup_join

# ---- roles -----------------------------------------------------------------


def role_ratio(a: DataFrame, b: DataFrame, key: str, a_total: str, b_total: str,
               lo: float = ROLE_LOW, hi: float = ROLE_HIGH, ratio: str = "ratio", role: str = "role",
               names: tuple[str, str, str] = ("Batter", "Pitcher", "Two-Way")) -> DataFrame:
    """Full outer join of two per-role totals and the role that their rounded ratio implies."""
    return with_role(a.join(b, [key], "full"), a_total, b_total, lo, hi, ratio, role, names)


def with_role(totals: DataFrame, a_total: str, b_total: str, lo: float = ROLE_LOW, hi: float = ROLE_HIGH, ratio: str = "ratio",
              role: str = "role", names: tuple[str, str, str] = ("Batter", "Pitcher", "Two-Way")) -> DataFrame:
    """Adds the ratio of the totals in two roles, and the role that it implies; a total is missing where the role never was."""
    name_a, name_b, name_both = names
    value = round_half_up(F.col(a_total).cast("double") / F.col(b_total).cast("double"), 2)
    return totals.withColumn(ratio, value).withColumn(
        role,
        F.when(F.col(b_total).isNull(), name_a)
        .when(F.col(a_total).isNull(), name_b)
        .when(F.col(ratio) < lo, name_b)
        .when(F.col(ratio) <= hi, name_both)
        .when(F.col(ratio) > hi, name_a),
    )


def role_flags(roles: DataFrame, key: str, total: str, out: str, out_of_role: str, role: str = "role") -> DataFrame:
    """Entities that ever had this role, flagged TRUE where it is not their own."""
    return roles.filter(F.col(total) >= 1).select(key, (F.col(role) == out_of_role).alias(out))


def attach_flags(log: DataFrame, flags: DataFrame, log_key: str, key: str | None = None,
                 heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Inner join of a per-entity flag table to the log; each entity has one flag row."""
    renamed = flags.withColumnRenamed(key or log_key, "_flag_key")
    return lookup_join(log, renamed, {log_key: "_flag_key"}, "inner", heavy=heavy).drop("_flag_key")


def drop_out_of_role(log: DataFrame, flag: str) -> DataFrame:
    return log.filter(~F.col(flag))


# ---- classes by threshold --------------------------------------------------


def status_at(df: DataFrame, last: str, cut: str, out: str = "status") -> DataFrame:
    """ACTIVE after the cut date, INACTIVE before it, no status on the day itself."""
    day = F.lit(cut).cast("date")
    return df.withColumn(out, F.when(F.col(last) > day, "ACTIVE").when(F.col(last) < day, "INACTIVE"))


def workload_class(df: DataFrame, avg_count: str, min_inning: str, mean_inning: str, out: str = "workload_class",
                   starter: float = STARTER_PITCHES, reliever: float = RELIEVER_PITCHES,
                   late: float = RELIEVER_MEAN_INNING, first_inning: int = 1) -> DataFrame:
    return df.withColumn(
        out,
        F.when(F.col(avg_count) >= starter, "STARTER")
        .when(F.col(avg_count) <= reliever, "RELIEVER")
        .when(F.col(min_inning) > first_inning, "RELIEVER")
        .when(F.col(mean_inning) > late, "RELIEVER")
        .otherwise("OTHER"),
    )


def ranked_flag(rank: str | Column, top: int = 100) -> Column:
    r = as_col(rank)
    return F.when(r.between(1, top), "Y").when(r.isNull(), "N")


def rank_group(rank: str | Column, edges: Sequence[tuple[int, int]] = RANK_EDGES, missing: str = "Unranked") -> Column:
    r = as_col(rank)
    out = F.when(r.isNull(), missing)
    for lo, hi in edges:
        out = out.when(r.between(lo, hi), f"{lo} - {hi}")
    return out


# ---- grades ----------------------------------------------------------------


def grade(value: str | Column, bands: Sequence[tuple[int | None, str]] = HIGHER_IS_BETTER, *,
          total: str | Column | None = None, min_total: int | None = None, dnq: str = "DNQ",
          scope: Column | None = None) -> Column:
    """Band of a rate, by lower bounds in thousandths.

    Rows outside ``scope`` get no grade; then rows with ``total`` below ``min_total`` did not qualify; a missing
    value has no band.
    """
    milli = thousandths(value)
    out = F.when(milli.isNull(), F.lit(None).cast("string"))
    for bound, name in bands:
        out = out.otherwise(name) if bound is None else out.when(milli >= bound, name)
    if min_total is not None:
        out = F.when(as_col(total) < min_total, dnq).otherwise(out)
    if scope is not None:
        out = F.when(scope, out)
    return out


def inverted_grade(value: str | Column, **gates) -> Column:
    """Grade where a lower rate is better."""
    return grade(value, LOWER_IS_BETTER, **gates)


def mapped(c: str | Column, values: Mapping) -> Column:
    """Value of a small fixed mapping; NULL for anything else."""
    c, out = as_col(c), None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def simple_grade(c: str | Column, dnq_as: str = "DNQ") -> Column:
    """Grades collapsed to Good, Average and Bad; ``dnq_as`` says what not qualifying counts as."""
    c = as_col(c)
    return (F.when(c.isin("Elite", "Great", "Good"), "Good").when(c == "Average", "Average")
            .when(c.isin("Below Average", "Poor", "Awful"), "Bad").when(c == "DNQ", dnq_as))


def grade_score(c: str | Column) -> Column:
    return mapped(c, GRADE_SCORES)


def level_order(c: str | Column, levels: Sequence[str]) -> Column:
    """Position of a category in its level list, from 1; sorts like an ordered factor."""
    return mapped(c, {name: i for i, name in enumerate(levels, 1)})
