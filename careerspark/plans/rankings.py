"""Ranking lists to resolved rankings, and the ranking in force at debut.

A list has some hundred names a year, so no name is listed often enough to matter and nothing is counted to find out
(``heavy=None``). The resolved list is read several times: save it first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LATE_EIGHTIES_AFTER, MIN_GAP_WEEKS, NEW_PEOPLE_AFTER, REFRESH_DEBUT_AFTER
from ..functions.scalars import date_lit, full_name, title_case, year_date
from ..operators.classify import mapped
from ..operators.report import debut_rate
from ..operators.resolve import (Correction, Step, apply_aliases, apply_corrections, latest_ranking, rank_gap, refresh_ids,
                                 resolve_cascade)
from ..operators.skew import join_known
from .fixed_names import ALIASES, AMBIGUOUS_IN_UPDATE, CORRECTIONS, GENERAL_ALIASES, ID_BY_NAME


def prepared(rankings: DataFrame, general_aliases: Mapping[str, str] = GENERAL_ALIASES) -> DataFrame:
    """Known misspellings, team names in title case, the year as a date."""
    named = apply_aliases(rankings, general_aliases, "PLAYER_NAME")
    return named.withColumns({"TEAM": title_case("TEAM"), "YEAR": year_date("YEAR")})


def resolved_rankings(rankings: DataFrame, people: DataFrame, batters: DataFrame, pitchers: DataFrame,
                      aliases: Mapping[str, str] = ALIASES, id_by_name: Mapping[str, str] = ID_BY_NAME,
                      corrections: Sequence[Correction] = CORRECTIONS) -> DataFrame:
    """Rankings with IDs, debut dates and the weeks from debut to ranking. ``people`` is the whole people table, not
    only those who began in the period.

    Sources in order: the ID that was given, batters, pitchers, people who began after the play log ends, and with
    corrected names all people since the late eighties.
    """
    named = people.withColumn("PLAYER_NAME", full_name("NICKNAME", "LAST"))
    recent = F.col("PLAY_DEBUT") > date_lit(NEW_PEOPLE_AFTER)
    since_eighties = F.col("PLAY_DEBUT") > date_lit(LATE_EIGHTIES_AFTER)
    out = resolve_cascade(
        prepared(rankings),
        [Step(batters, "BAT_NAME", "BAT_ID"), Step(pitchers, "PIT_NAME", "PIT_ID"),
         Step(named, "PLAYER_NAME", "PLAYERID", recent), Step(named, "PLAYER_NAME", "PLAYERID", since_eighties, aliased=True)],
        name="PLAYER_NAME", id="ID", aliases=aliases, heavy=None)
    if id_by_name:
        last = F.col("resolved_by").isNull() | (F.col("resolved_by") == 4)
        fixed = F.coalesce(mapped("PLAYER_NAME", id_by_name), F.col("ID"))
        out = out.withColumn("ID", F.when(last, fixed).otherwise(F.col("ID")))
    out = out.drop("resolved_by")
    out = apply_corrections(out.distinct(), corrections)
    debuts = people.filter(since_eighties).select(F.col("PLAYERID").alias("_person"), F.col("PLAY_DEBUT"))
    dated = join_known(out, debuts, "ID", "_person").drop("_person")
    return rank_gap(dated, "YEAR", "PLAY_DEBUT", "RANK_DEBUT_DATEDIFF_WKS").drop("MLB_DEBUT")


def ranking_at_debut(resolved: DataFrame, min_gap: float = MIN_GAP_WEEKS) -> DataFrame:
    return latest_ranking(resolved, "ID", "RANK_DEBUT_DATEDIFF_WKS", min_gap, heavy=None)


def refreshed_rankings(resolved: DataFrame, people_update: DataFrame) -> DataFrame:
    """Published rankings, with late debuts from a newer people table."""
    update = people_update.filter(F.col("PLAY_DEBUT") > date_lit(REFRESH_DEBUT_AFTER)).withColumn(
        "_full", full_name("NICKNAME", "LAST"))
    return refresh_ids(
        resolved, update, name="PLAYER_NAME", id="ID", year="YEAR", debut="PLAY_DEBUT", gap="RANK_DEBUT_DATEDIFF_WKS",
        update_name="_full", update_id="PLAYERID", update_debut="PLAY_DEBUT", exclude=AMBIGUOUS_IN_UPDATE, heavy=None)


def debut_rates(resolved: DataFrame, pitchers: bool) -> DataFrame:
    """How many ranked pitchers, or other players, reached a debut, by rank group."""
    role = F.col("POSITION_1") == 1 if pitchers else F.col("POSITION_1") != 1
    return debut_rate(resolved, name="PLAYER_NAME", entity="ID", year="YEAR", rank="PROSPECT_RANK", debut="PLAY_DEBUT",
                      gap="RANK_DEBUT_DATEDIFF_WKS", role=role, heavy=None)
