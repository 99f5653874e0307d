"""Declared schemas of the baseball files and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BIOGRAPHY_FROM, LAST_GAME_FILL
from ..functions.scalars import date_lit, full_name
from ..sources.delimited import YEAR_ONLY, read_csv

_S, _I, _L, _D, _B, _DATE = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.replace("__", "."), dtype) for name, dtype in columns.items()])


PLAYS = _schema(
    row_idx=_L, GAME_ID=_S, PARK=_S, DATE=_DATE, HOME_TEAM_ID=_S, AWAY_TEAM_ID=_S, INNING=_I, BAT_HOME_IND=_I,
    BAT_ID=_S, BAT_NAME=_S, FIELD_POS=_I, PIT_ID=_S, PIT_NAME=_S, EVENT_TX=_S, HIT_VAL=_I, EVENT_RUNS=_I,
    EVENT_WOBA=_D, PA_IND=_B, WOBA_APP=_B, PITCH_COUNT_FINAL=_I, PIT_REST=_I)

PEOPLE = _schema(
    PLAYERID=_S, NICKNAME=_S, LAST=_S, BIRTHDATE=_DATE, PLAY__DEBUT=_DATE, PLAY__LASTGAME=_DATE, MGR__DEBUT=_DATE,
    MGR__LASTGAME=_DATE, COACH__DEBUT=_DATE, COACH__LASTGAME=_DATE, UMP__DEBUT=_DATE, UMP__LASTGAME=_DATE,
    DEATHDATE=_DATE, HEIGHT=_S)
PEOPLE_DATES = {f.name: "M/d/yyyy" for f in PEOPLE if isinstance(f.dataType, T.DateType)}

WEIGHTS = _schema(Season=_DATE, wBB=_D, wHBP=_D, w1B=_D, w2B=_D, w3B=_D, wHR=_D)
WEIGHTS_DATES = {"Season": YEAR_ONLY}

LEADERBOARD = _schema(TBF=_L, IP=_D)

RANKINGS = _schema(
    PLAYER_NAME=_S, TEAM=_S, YEAR=_I, PROSPECT_RANK=_I, ID=_S, POSITION_1=_D, POSITION_2=_D, POSITION_3=_D,
    POSITION_4=_D, POSITION_5=_D, MLB_DEBUT=_S)


def read_plays(spark: SparkSession, path: str, date_format: str = "yyyyMMdd") -> DataFrame:
    """Play log. The file may have more columns than the ones used here, in any order."""
    return read_csv(spark, path, PLAYS, {"DATE": date_format})


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """People, with dots in column names replaced so that columns can be named without quoting."""
    people = read_csv(spark, path, PEOPLE, PEOPLE_DATES)
    return people.toDF(*[c.replace(".", "_") for c in people.columns])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, WEIGHTS, WEIGHTS_DATES)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LEADERBOARD, {})


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RANKINGS, {})


def current_people(people: DataFrame) -> DataFrame:
    """People who began in the period, with a missing last game filled in, and a full name."""
    return (people.filter(F.col("PLAY_DEBUT") >= date_lit(BIOGRAPHY_FROM))
            .withColumn("PLAY_LASTGAME", F.coalesce(F.col("PLAY_LASTGAME"), date_lit(LAST_GAME_FILL)))
            .withColumn("NAME", full_name("NICKNAME", "LAST")))
