"""Play log and people to one graded row per player.

Both roles come from the same two passes over the log. The first gives totals per role and player, which are one small
table: roles, and the players with more events than a task should sort, follow from it. In the second an event stands once
for each role; entities outside the cohort or out of their role leave before events are numbered (both are properties of
the whole entity), and every mean, total and attribute comes from sums between milestones on the same partitioning. Ages
need no join to the log, because a mean age is a mean date minus the birth date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (BATTER_CUTS, BATTER_GATES, BATTER_STEP, COHORT_AFTER, PITCHER_CUTS, PITCHER_GATES, PITCHER_STEP,
                      PUBLISH_BEFORE, STATUS_CUT)
from ..functions.scalars import years_from_weeks
from ..operators.classify import (grade, inverted_grade, rank_group, ranked_flag, role_flags, simple_grade, status_at, with_role,
                                  workload_class)
from ..operators.report import publish
from ..operators.resolve import attach_person, attach_ranking
from ..operators.sequence import bucket_mean_of, bucket_sums, cohort, number_events, split_diff
from ..operators.shape import round_cols
from ..operators.skew import lookup_join, oversized_of
from ..sources.stages import session_stages

ORDER = ["DATE", "row_idx"]
QUARTERS = ("ONE", "TWO", "THREE", "FOUR")
ROLES = ("BAT", "PIT")
WORKLOAD = ("PITCH_COUNT_FINAL", "INNING", "PIT_REST")
_STEPS = {"BAT": (BATTER_STEP, BATTER_CUTS), "PIT": (PITCHER_STEP, PITCHER_CUTS)}
_TOTAL = {"BAT": "TOTAL_PA_WOBA", "PIT": "TOTAL_BF_WOBA"}
_OUT = {"BAT": "Pitcher", "PIT": "Batter"}


def measured(plays: DataFrame) -> DataFrame:
    """Events that count for the measure."""
    return plays.filter(F.col("WOBA_APP"))


def in_roles(log: DataFrame, roles: Sequence[str], *columns: str) -> DataFrame:
    """Each event once for each role that has an ID: ROLE, PLAYER_ID, NAME and the columns."""
    sides = F.array(*[F.struct(F.lit(r).alias("ROLE"), F.col(f"{r}_ID").alias("PLAYER_ID"), F.col(f"{r}_NAME").alias("NAME")) for r in roles])
    return log.select(*columns, F.inline(sides)).filter(F.col("PLAYER_ID").isNotNull())


def role_totals(log: DataFrame) -> DataFrame:
    """Events and mean measure per role and player: one pass, summed in each task before the shuffle."""
    return in_roles(log, ROLES, "EVENT_WOBA").groupBy("ROLE", "PLAYER_ID").agg(F.count(F.lit(1)).alias("EVENTS"), F.avg("EVENT_WOBA").alias("MEAN"))


def player_roles(log: DataFrame) -> DataFrame:
    """Totals in both roles, their ratio and the role it implies."""
    return roles_of(role_totals(log))


def roles_of(totals: DataFrame) -> DataFrame:
    def of(role: str, value: str) -> Column:
        return F.max(F.when(F.col("ROLE") == role, F.col(value)))

    wide = totals.groupBy("PLAYER_ID").agg(
        of("BAT", "EVENTS").alias("TOTAL_PA_WOBA"), of("BAT", "MEAN").alias("CAREER_WOBA_BAT"),
        of("PIT", "EVENTS").alias("TOTAL_BF_WOBA"), of("PIT", "MEAN").alias("CAREER_WOBA_PIT"))
    roles = with_role(wide, "TOTAL_PA_WOBA", "TOTAL_BF_WOBA", ratio="PA_BF_RATIO", role="PLAYER_TYPE")
    return round_cols(roles, ["CAREER_WOBA_BAT", "CAREER_WOBA_PIT"], 3)


def _eligible(totals: DataFrame, people: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Players of the cohort in their own roles."""
    typed = roles_of(totals)
    own = [role_flags(typed, "PLAYER_ID", _TOTAL[r], "_out", _OUT[r], role="PLAYER_TYPE").filter(~F.col("_out")).select(F.lit(r).alias("ROLE"), "PLAYER_ID") for r in roles]
    members = cohort(people, "PLAY_DEBUT", after=COHORT_AFTER).select(F.col("PLAYERID").alias("PLAYER_ID"))
    return reduce(DataFrame.unionByName, own).join(members, "PLAYER_ID", "left_semi").withColumnsRenamed({"ROLE": "_role", "PLAYER_ID": "_player"})


def career_sums(plays: DataFrame, people: DataFrame, order: Sequence[str] = ORDER, roles: Sequence[str] = ROLES) -> DataFrame:
    """One row per role and player of the cohort: sums between milestones, name, and workload of pitchers.

    Two scans of the log, however many roles: totals (written, as roles, sizes and large players are read from them), then
    the numbered events.
    """
    log = measured(plays)
    totals = session_stages(log.sparkSession).keep(role_totals(log), "role-totals")
    heavy = oversized_of(totals.filter(F.col("ROLE").isin(*roles)), ["ROLE", "PLAYER_ID"], "EVENTS")
    fields = WORKLOAD if "PIT" in roles else ()
    events = in_roles(log, roles, *dict.fromkeys([*order, "DATE", "EVENT_WOBA", *fields]))
    own = lookup_join(events, _eligible(totals, people, roles), {"ROLE": "_role", "PLAYER_ID": "_player"}, "left_semi", heavy=heavy)
    numbered = number_events(own, ["ROLE", "PLAYER_ID"], order, "_num", heavy).withColumn("_day", F.unix_date("DATE"))
    edges = [reduce(lambda out, r: out.when(F.col("ROLE") == r, _edges(r)[i]), roles[1:], F.when(F.col("ROLE") == roles[0], _edges(roles[0])[i]))
             for i in range(len(_edges(roles[0])))]
    extra = {"_last": (F.max(F.struct(*order, F.col("NAME").alias("_name"))), "max"), "_events": (F.count(F.lit(1)), "sum")}
    for f in fields:
        extra |= {f"_{f}_sum": (F.sum(f).cast("double"), "sum"), f"_{f}_n": (F.count(f), "sum"), f"_{f}_min": (F.min(f), "min")}
    return bucket_sums(numbered, ["ROLE", "PLAYER_ID"], "_num", edges, ["EVENT_WOBA", "_day"], extra)


def _edges(role: str) -> list[int]:
    step, cuts = _STEPS[role]
    return sorted({*cuts, *[step * (i + 1) for i in range(len(QUARTERS))]})


def _careers(sums: DataFrame, people: DataFrame, role: str, extra: Mapping[str, Column] = {}) -> DataFrame:
    key, name, total = f"{role}_ID", f"{role}_NAME", f"CAREER_{_TOTAL[role].removesuffix('_WOBA')}"
    (step, cuts), edges = _STEPS[role], _edges(role)
    last = len(edges)

    def mean(measure: str, above: int, upto: int | None) -> Column:
        """Mean over the events after number ``above`` up to number ``upto``."""
        return bucket_mean_of(measure, 0 if above == 0 else edges.index(above) + 1, last if upto is None else edges.index(upto))

    columns = {}
    for i, q in enumerate(QUARTERS):
        columns[f"QUARTILE_{q}_WOBA"] = mean("EVENT_WOBA", i * step, (i + 1) * step)
        columns[f"QUARTILE_{q}_AGE"] = mean("_day", i * step, (i + 1) * step)
    columns[f"FIRST_{4 * step}_MEAN_AGE"] = mean("_day", 0, 4 * step)
    for n in cuts:
        if n != step:                                           # that is the first quarter
            columns[f"FIRST_{n}_WOBA"] = mean("EVENT_WOBA", 0, n)
        columns[f"POST_{n}_WOBA"] = mean("EVENT_WOBA", n, None)
    careers = sums.filter(F.col("ROLE") == role).select(
        F.col("PLAYER_ID").alias(key), F.col("_last._name").alias(name), mean("EVENT_WOBA", 0, None).alias(f"CAREER_WOBA_{role}"),
        F.col("_events").alias(total), *[c.alias(n) for n, c in extra.items()], *[c.alias(n) for n, c in columns.items()])
    dated = attach_person(careers, people, key, "PLAYERID", f"{role}_", ["BIRTHDATE", "PLAY_DEBUT", "PLAY_LASTGAME"], heavy=None)
    ages = [c for c in columns if c.endswith("_AGE")]
    born = F.unix_date(f"{role}_BIRTHDATE")
    dated = dated.withColumns({c: years_from_weeks((F.col(c) - born) / 7.0) for c in ages})
    dated = dated.withColumnsRenamed({f"{role}_PLAY_DEBUT": f"{role}_DEBUT", f"{role}_PLAY_LASTGAME": f"{role}_LASTGAME"})
    for cut, first in ((step, "QUARTILE_ONE_WOBA"), (4 * step, f"FIRST_{4 * step}_WOBA")):
        dated = split_diff(dated, first, f"POST_{cut}_WOBA", f"FIRST_POST_{cut}_WOBA_DIFF")
    rates = [f"CAREER_WOBA_{role}", *[c for c in columns if c.endswith("_WOBA")]]
    dated = round_cols(round_cols(dated, rates, 3), ages, 1)
    return status_at(dated, f"{role}_LASTGAME", STATUS_CUT, "PLAYER_STATUS")


def _graded(df: DataFrame, grades: Mapping[str, Column], post: tuple[str, ...]) -> DataFrame:
    """Grades, and their simple form in which not qualifying after a milestone counts as bad."""
    out = df.withColumns(dict(grades))
    return out.withColumns({f"{g}_SIMPLE": simple_grade(g, "Bad" if g in post else "DNQ") for g in grades})


def _ranked(df: DataFrame, latest: DataFrame | None, key: str) -> DataFrame:
    if latest is None:
        return df
    return attach_ranking(df, latest, key, "ID", "PROSPECT_RANK").withColumns({
        "PROSPECT_RANK_GROUP": rank_group("PROSPECT_RANK"), "TOP_100_PROSPECT": ranked_flag("PROSPECT_RANK")})


def both(plays: DataFrame, people: DataFrame, latest_bat: DataFrame | None = None, latest_pit: DataFrame | None = None,
         null_policy: str = "propagate", order: Sequence[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """``batters`` and ``pitchers`` from the same two scans of the log; their sums, a row per player, are written once."""
    sums = session_stages(plays.sparkSession).keep(career_sums(plays, people, order), "career-sums")
    return _batters(sums, people, latest_bat), _pitchers(sums, people, latest_pit, null_policy)


def batters(plays: DataFrame, people: DataFrame, latest: DataFrame | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per batter. ``latest`` is the ranking in force at debut, ``order`` the total order of the log."""
    return _batters(career_sums(plays, people, order, ["BAT"]), people, latest)


def _batters(sums: DataFrame, people: DataFrame, latest: DataFrame | None) -> DataFrame:
    out = _careers(sums, people, "BAT")

    def graded(value: str, gate: str) -> Column:
        return grade(value, total="CAREER_TOTAL_PA", min_total=BATTER_GATES[gate])

    out = _graded(out, {
        "FIRST_150_WOBA_GRADE": graded("QUARTILE_ONE_WOBA", "FIRST_150"),
        "FIRST_600_WOBA_GRADE": graded("FIRST_600_WOBA", "FIRST_600"),
        "POST_150_WOBA_GRADE": graded("POST_150_WOBA", "POST_150"),
        "POST_600_WOBA_GRADE": graded("POST_600_WOBA", "POST_600"),
    }, ("POST_150_WOBA_GRADE", "POST_600_WOBA_GRADE"))
    out = out.withColumn("CAREER_WOBA_GRADE", graded("CAREER_WOBA_BAT", "CAREER"))
    return _ranked(out, latest, "BAT_ID")


def pitchers(plays: DataFrame, people: DataFrame, latest: DataFrame | None = None, null_policy: str = "propagate",
             order: Sequence[str] = ORDER) -> DataFrame:
    """One row per pitcher, lower rates graded better.

    ``null_policy`` applies to the workload fields: a pitcher with one unknown pitch count has no mean pitch count,
    and is classed by innings. ``skip`` takes the mean of the known ones.
    """
    return _pitchers(career_sums(plays, people, order, ["PIT"]), people, latest, null_policy)


def _pitchers(sums: DataFrame, people: DataFrame, latest: DataFrame | None, null_policy: str) -> DataFrame:
    if null_policy not in ("skip", "propagate"):
        raise ValueError(f"null_policy must be 'skip' or 'propagate', not {null_policy!r}")

    def known(field: str, value: Column) -> Column:
        return value if null_policy == "skip" else F.when(F.col(f"_{field}_n") == F.col("_events"), value)

    def mean(field: str) -> Column:
        return known(field, F.try_divide(F.col(f"_{field}_sum"), F.col(f"_{field}_n").cast("double")))

    out = _careers(sums, people, "PIT", {
        "AVG_PIT_COUNT": mean("PITCH_COUNT_FINAL"), "IP_MIN": known("INNING", F.col("_INNING_min")),
        "AVG_DAYS_REST": mean("PIT_REST"), "IP_MEAN": mean("INNING")})
    out = workload_class(out, "AVG_PIT_COUNT", "IP_MIN", "IP_MEAN", "PITCHER_TYPE")
    out = round_cols(out, ["AVG_PIT_COUNT", "AVG_DAYS_REST", "IP_MEAN"], 1)
    starter = F.col("PITCHER_TYPE") == "STARTER"

    def graded(value: str, gate: str, scope: Column | None = None) -> Column:
        return inverted_grade(value, total="CAREER_TOTAL_BF", min_total=PITCHER_GATES[gate], scope=scope)

    out = _graded(out, {
        "FIRST_215_WOBA_GRADE": graded("QUARTILE_ONE_WOBA", "FIRST_215"),
        "FIRST_860_WOBA_GRADE_SP": graded("FIRST_860_WOBA", "FIRST_860_SP", starter),
        "POST_215_WOBA_GRADE_SP": graded("POST_215_WOBA", "POST_215_SP", starter),
        "POST_215_WOBA_GRADE_NON_SP": graded("POST_215_WOBA", "POST_215_NON_SP", ~starter),
        "POST_860_WOBA_GRADE_SP": graded("POST_860_WOBA", "POST_860_SP", starter),
    }, ("POST_215_WOBA_GRADE_SP", "POST_215_WOBA_GRADE_NON_SP", "POST_860_WOBA_GRADE_SP"))
    out = out.withColumn("CAREER_WOBA_GRADE", graded("CAREER_WOBA_PIT", "CAREER"))
    return _ranked(out, latest, "PIT_ID")


# ---- published tables ------------------------------------------------------

_RANK = ["PROSPECT_RANK", "PROSPECT_RANK_GROUP", "TOP_100_PROSPECT"]

BATTER_COLUMNS = {c: c for c in [
    "BAT_ID", "BAT_NAME", "BAT_DEBUT", "BAT_LASTGAME", *_RANK, "CAREER_WOBA_BAT", "CAREER_TOTAL_PA", "PLAYER_STATUS"]}
BATTER_COLUMNS |= {"QUARTILE_ONE_WOBA": "FIRST_150_WOBA"}
BATTER_COLUMNS |= {c: c for c in [
    "FIRST_300_WOBA", "FIRST_450_WOBA", "FIRST_600_WOBA", "FIRST_900_WOBA",
    "FIRST_150_WOBA_GRADE", "FIRST_150_WOBA_GRADE_SIMPLE", "FIRST_600_WOBA_GRADE", "FIRST_600_WOBA_GRADE_SIMPLE",
    "POST_150_WOBA", "POST_300_WOBA", "POST_450_WOBA", "POST_600_WOBA", "POST_900_WOBA",
    "POST_150_WOBA_GRADE", "POST_150_WOBA_GRADE_SIMPLE", "POST_600_WOBA_GRADE", "POST_600_WOBA_GRADE_SIMPLE",
    "FIRST_POST_150_WOBA_DIFF", "FIRST_POST_600_WOBA_DIFF"]}

PITCHER_COLUMNS = {c: c for c in [
    "PIT_ID", "PIT_NAME", "PIT_DEBUT", "PIT_LASTGAME", *_RANK, "CAREER_WOBA_PIT", "CAREER_TOTAL_BF",
    "AVG_PIT_COUNT", "IP_MIN", "AVG_DAYS_REST", "IP_MEAN", "PLAYER_STATUS", "PITCHER_TYPE"]}
PITCHER_COLUMNS |= {"QUARTILE_ONE_WOBA": "FIRST_215_WOBA"}
PITCHER_COLUMNS |= {c: c for c in [
    "FIRST_430_WOBA", "FIRST_645_WOBA", "FIRST_860_WOBA", "FIRST_1290_WOBA",
    "FIRST_215_WOBA_GRADE", "FIRST_215_WOBA_GRADE_SIMPLE", "FIRST_860_WOBA_GRADE_SP", "FIRST_860_WOBA_GRADE_SP_SIMPLE",
    "POST_215_WOBA", "POST_430_WOBA", "POST_645_WOBA", "POST_860_WOBA", "POST_1290_WOBA",
    "POST_215_WOBA_GRADE_SP", "POST_215_WOBA_GRADE_SP_SIMPLE", "POST_215_WOBA_GRADE_NON_SP",
    "POST_215_WOBA_GRADE_NON_SP_SIMPLE", "POST_860_WOBA_GRADE_SP", "POST_860_WOBA_GRADE_SP_SIMPLE",
    "FIRST_POST_215_WOBA_DIFF", "FIRST_POST_860_WOBA_DIFF"]}


def publish_players(players: DataFrame, role: str, before: str = PUBLISH_BEFORE) -> DataFrame:
    """Published table of one role (``BAT`` or ``PIT``): final columns, players who began before the date."""
    columns = {"BAT": BATTER_COLUMNS, "PIT": PITCHER_COLUMNS}[role]
    return publish(players, columns, f"{role}_DEBUT", before)
