"""The published reports over the graded player tables and the play log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GRADE_LEVELS, PUBLISH_BEFORE, RANK_LEVELS, SIMPLE_FIRST_LEVELS, SIMPLE_POST_LEVELS
from ..functions.scalars import mirrored, percent_label
from ..operators.report import (add_totals, band_share, before_after_summary, crosstab, crosstab3, median, occurrence_rate,
                                row_percent, top_k, top_k_summary, transition_share)
from ..operators.sequence import cohort, tail_matches
from ..operators.shape import complete_grid, share
from ..operators.stats import kde, ols, ols_band, pearson, scatter

GROUP = "PROSPECT_RANK_GROUP"


@dataclass(frozen=True)
class Milestone:
    """One milestone: its columns, the career total its before/after tables ask for, and that of its density."""

    first: str
    post: str
    first_grade: str
    post_grade: str
    diff: str
    summary_total: int


@dataclass(frozen=True)
class Role:
    key: str
    name: str
    debut: str
    career: str
    total: str
    early: Milestone
    late: Milestone
    density_total: int      # career total for the distribution of career values
    regression_total: int   # career total for correlations and top lists
    best_first: bool        # higher rates are better
    scope: Column | None
    top: int

    def players(self, df: DataFrame, min_total: int = 0) -> DataFrame:
        out = cohort(df, self.debut, before=PUBLISH_BEFORE)
        if self.scope is not None:
            out = out.filter(self.scope)
        return out.filter(F.col(self.total) >= min_total) if min_total else out


def batter_role() -> Role:
    return Role(
        "BAT_ID", "BAT_NAME", "BAT_DEBUT", "CAREER_WOBA_BAT", "CAREER_TOTAL_PA",
        Milestone("QUARTILE_ONE_WOBA", "POST_150_WOBA", "FIRST_150_WOBA_GRADE", "POST_150_WOBA_GRADE", "FIRST_POST_150_WOBA_DIFF", 600),
        Milestone("FIRST_600_WOBA", "POST_600_WOBA", "FIRST_600_WOBA_GRADE", "POST_600_WOBA_GRADE", "FIRST_POST_600_WOBA_DIFF", 1800),
        150, 1800, True, None, 100)


def starter_role() -> Role:
    return Role(
        "PIT_ID", "PIT_NAME", "PIT_DEBUT", "CAREER_WOBA_PIT", "CAREER_TOTAL_BF",
        Milestone("QUARTILE_ONE_WOBA", "POST_215_WOBA", "FIRST_215_WOBA_GRADE", "POST_215_WOBA_GRADE_SP", "FIRST_POST_215_WOBA_DIFF", 860),
        Milestone("FIRST_860_WOBA", "POST_860_WOBA", "FIRST_860_WOBA_GRADE_SP", "POST_860_WOBA_GRADE_SP", "FIRST_POST_860_WOBA_DIFF", 2580),
        215, 2580, False, F.col("PITCHER_TYPE") == "STARTER", 50)


def simple_grade_shares(players: DataFrame, role: Role, m: Milestone, by_group: bool = False, label_above: float = 0.035) -> DataFrame:
    """Share of players per pair of simple grades, of all players or of each rank group, with bar labels."""
    first, post = f"{m.first_grade}_SIMPLE", f"{m.post_grade}_SIMPLE"
    levels = {first: SIMPLE_FIRST_LEVELS, post: SIMPLE_POST_LEVELS} | ({GROUP: RANK_LEVELS} if by_group else {})
    counts = role.players(players).groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    full = share(complete_grid(counts, levels, {"n": 0}), "n", by=[GROUP] if by_group else None)
    return full.withColumn("label", percent_label("share", label_above))


def grade_crosstabs(players: DataFrame, role: Role, m: Milestone) -> DataFrame:
    """Grade before x grade after for each rank group, with totals and row shares."""
    levels = {GROUP: RANK_LEVELS, m.first_grade: GRADE_LEVELS, m.post_grade: GRADE_LEVELS}
    ct = add_totals(crosstab3(role.players(players), m.first_grade, m.post_grade, GROUP, levels), m.first_grade, m.post_grade, [GROUP])
    return row_percent(ct, m.first_grade, m.post_grade, [GROUP])


def improved_share(players: DataFrame, role: Role, m: Milestone, from_grade: str, at_least: str) -> DataFrame:
    ct = crosstab3(role.players(players), m.first_grade, m.post_grade, GROUP)
    return transition_share(ct, GROUP, m.first_grade, m.post_grade, GRADE_LEVELS, from_grade, at_least)


def summary_table(players: DataFrame, role: Role) -> DataFrame:
    """Before/after means at both milestones by rank group, and the share of players that remain for the second."""
    early = before_after_summary(role.players(players, role.early.summary_total), GROUP, role.early.first, role.early.post,
                                 names=("early_first", "early_post", "early_difference", "n_early"))
    late = before_after_summary(role.players(players, role.late.summary_total), GROUP, role.late.first, role.late.post,
                                names=("late_first", "late_post", "late_difference", "n_late"))
    pct = F.floor(F.try_divide(F.col("n_late").cast("double"), F.col("n_early").cast("double")) * 100.0 + 0.5)
    return early.join(late, GROUP, "left").withColumn("pct_remaining", pct.cast("double"))


def movement_density(players: DataFrame, role: Role, m: Milestone) -> DataFrame:
    """Distribution of the before/after difference of ranked and unranked players."""
    kept = role.players(players, role.early.summary_total if m is role.early else role.late.summary_total)
    return kde(kept.filter(F.col(m.post).isNotNull()), m.diff, ["TOP_100_PROSPECT"], limits=(-0.15, 0.15))


def career_density(players: DataFrame, role: Role) -> DataFrame:
    return kde(role.players(players, role.density_total), role.career, [GROUP])


def career_pyramid(players: DataFrame, role: Role) -> DataFrame:
    """Players per career grade, ranked players counted to the left of zero."""
    ct = crosstab(role.players(players, role.density_total), "CAREER_WOBA_GRADE", "TOP_100_PROSPECT")
    return ct.withColumn("signed_n", mirrored("n", F.col("TOP_100_PROSPECT") == "Y"))


def career_share(players: DataFrame, role: Role, at_least: str = "Good") -> DataFrame:
    return band_share(role.players(players), GROUP, "CAREER_WOBA_GRADE", GRADE_LEVELS, at_least)


def _best(role: Role) -> list[Column]:
    value = F.col(role.career).desc_nulls_last() if role.best_first else F.col(role.career).asc_nulls_last()
    return [value, F.col(role.key).asc_nulls_last()]


def top_players(players: DataFrame, role: Role, ranked: str = "Y") -> DataFrame:
    return top_k(role.players(players, role.regression_total), _best(role), role.top,
                 [role.name, role.career, "PROSPECT_RANK"], F.col("TOP_100_PROSPECT") == ranked)


def top_players_summary(players: DataFrame, role: Role, ranked: str = "Y") -> DataFrame:
    """Events, and median and mean rank, of the players in the top list."""
    return top_k_summary(role.players(players, role.regression_total), _best(role), role.top, [
        F.sum(role.total).alias("total_events"), median("PROSPECT_RANK").alias("median_rank"),
        F.avg("PROSPECT_RANK").alias("mean_rank")], F.col("TOP_100_PROSPECT") == ranked)


def risers(players: DataFrame, role: Role, m: Milestone, k: int = 20) -> DataFrame:
    """Smallest signed difference first."""
    return top_k(role.players(players, role.early.summary_total), [F.col(m.diff).asc_nulls_last(), F.col(role.key)], k,
                 [role.name, role.career, role.total, m.first, m.post, m.diff, "PLAYER_STATUS"], F.col(m.post).isNotNull())


def status_counts(players: DataFrame, role: Role) -> DataFrame:
    return role.players(players).groupBy("PLAYER_STATUS").agg(F.count(F.lit(1)).alias("n"))


def correlation(players: DataFrame, role: Role, first: str, post: str) -> DataFrame:
    return pearson(role.players(players, role.regression_total), first, post)


def regression(players: DataFrame, role: Role, first: str, post: str) -> dict[str, DataFrame]:
    """Points, line and confidence band of one milestone."""
    kept = role.players(players, role.regression_total)
    return {"points": scatter(kept, first, post, GROUP, role.key), "line": ols(kept, first, post), "band": ols_band(kept, first, post)}


def home_run_endings(plays: DataFrame, n: int = 2) -> DataFrame:
    """Last plate appearances of the games that ended in ``n`` home runs in a row."""
    return tail_matches(plays, "GAME_ID", ["DATE", "row_idx"], n, F.col("HIT_VAL") == 4, F.col("PA_IND"))


def home_run_ending_rate(plays: DataFrame, n: int = 2) -> DataFrame:
    return occurrence_rate(plays, home_run_endings(plays, n), "GAME_ID")
