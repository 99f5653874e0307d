"""The whole analysis on a small made-up league, against a plain Python calculation of the same rules."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from careerspark.config import BATTER_CUTS, GRADES, PITCHER_CUTS
from careerspark.plans import checks, inputs, players, rankings, reports
from careerspark.plans.fixed_names import ALIASES, CORRECTIONS

EVENTS = [("K", 0, 0.0), ("8", 0, 0.0), ("W", 0, 0.6875), ("S7", 1, 0.875), ("D8", 2, 1.25), ("T9", 3, 1.5625), ("HR", 4, 2.0)]
CHANCES = [38, 27, 9, 15, 6, 1, 4]


@pytest.fixture(scope="module")
def league(spark):
    """Twelve batters and eight pitchers; one pitcher also bats, one batter also pitches, one began before the cohort."""
    rng = random.Random(4)
    bats, pits = [f"bat{i:02d}" for i in range(12)], [f"pit{i:02d}" for i in range(8)]
    left = {b: (2000 if i < 4 else 700 if i < 8 else 100) for i, b in enumerate(bats)}
    rows, day, n = [], dt.date(1995, 4, 1), 0
    while left:
        game = f"G{n // 60:05d}"
        bat, pit = rng.choice(sorted(left)), rng.choice(pits[: 4 + n % 5])
        if n % 97 == 0:
            bat = "pit01"       # pitchers bat now and then
        if n % 601 == 0:
            pit = "bat01"       # and batters pitch
        if n % 113 == 0:
            bat = "two00"       # one player does both
        if n % 101 == 0:
            pit = "two00"
        text, hit, woba = rng.choices(EVENTS, CHANCES)[0]
        measured = rng.random() > .03
        rows.append((n, game, "P1", day + dt.timedelta(days=n // 60), "HOM", "AWY", 1 + n % 9, n % 2, bat, bat.upper(), 1, pit, pit.upper(),
                     text, hit, 5 if n == 7 else hit // 4, woba, True, measured, 90 if pit != "pit03" else 20, 4))
        if bat in left:
            left[bat] -= 1
            if not left[bat]:
                del left[bat]
        n += 1
    rng.shuffle(rows)
    plays = spark.createDataFrame(rows, inputs.PLAYS).cache()
    born = {p: dt.date(1970, 1, 1) + dt.timedelta(days=37 * i) for i, p in enumerate([*bats, *pits, "two00"])}
    debut = {p: dt.date(1995, 4, 1) for p in born} | {"bat11": dt.date(1989, 5, 1), "pit02": dt.date(2012, 1, 1)}
    people = inputs.current_people(spark.createDataFrame(
        [(p, p[:3].upper(), p[3:], born[p], debut[p], None if p == "bat00" else dt.date(2020, 9, 28)) for p in born],
        "PLAYERID string, NICKNAME string, LAST string, BIRTHDATE date, PLAY_DEBUT date, PLAY_LASTGAME date")).cache()
    lists = [("BAT00", 1, 1995, 7), ("BAT00", 3, 1994, 7), ("BAT01", 30, 1995, 7), ("bat 02", 60, 1996, 7), ("PIT00", 80, 1995, 1), ("Nobody", 90, 1995, 7)]
    listed = spark.createDataFrame([(name, "RED SOX", y, rank, None, float(pos), None, None, None, None, "x") for name, rank, y, pos in lists], inputs.RANKINGS)
    return {"plays": plays, "people": people, "rankings": listed, "rows": rows, "born": born}


def logs(league, role):
    """Measured events per player in order."""
    at = {"BAT": 8, "PIT": 11}[role]
    out = {}
    for r in sorted(league["rows"], key=lambda r: (r[3], r[0])):
        if r[18]:
            out.setdefault(r[at], []).append(r)
    return out


def half_up(x, d):
    return None if x is None else math.floor(x * 10 ** d + .5) / 10 ** d


def mean(xs):
    return sum(xs) / len(xs) if xs else None


def band(x, lower=False):
    milli = math.floor(x * 1000 + .5)
    at = next((i for i, b in enumerate((400, 370, 340, 320, 310, 291)) if milli >= b), 6)
    return GRADES[6 - at] if lower else GRADES[at]


@pytest.mark.parametrize("role,cuts,step", [("BAT", BATTER_CUTS, 150), ("PIT", PITCHER_CUTS, 215)])
def test_careers_equal_a_plain_calculation(spark, league, role, cuts, step):
    build = players.batters if role == "BAT" else players.pitchers
    got = {r[f"{role}_ID"]: r for r in build(league["plays"], league["people"]).collect()}
    own, other = logs(league, role), logs(league, "PIT" if role == "BAT" else "BAT")
    ratio = {p: half_up(len(own[p]) / len(other[p]), 2) if p in other else None for p in own}
    out_of_role = {p for p, q in ratio.items() if q is not None and (q < .8 if role == "BAT" else 1 / q > 4.25 if q else True)}
    expected = set(own) - out_of_role - {"bat11"}
    assert set(got) == expected and out_of_role
    total = "CAREER_TOTAL_PA" if role == "BAT" else "CAREER_TOTAL_BF"
    for p in expected:
        x, row = [r[16] for r in own[p]], got[p]
        assert row[total] == len(x) and row[f"CAREER_WOBA_{role}"] == half_up(mean(x), 3)
        assert row["QUARTILE_ONE_WOBA"] == half_up(mean(x[:step]), 3) and row["QUARTILE_THREE_WOBA"] == half_up(mean(x[2 * step:3 * step]), 3)
        for c in cuts:
            assert row[f"POST_{c}_WOBA"] == half_up(mean(x[c:]), 3)
            assert c == step or row[f"FIRST_{c}_WOBA"] == half_up(mean(x[:c]), 3)
        ages = [(r[3] - league["born"][p]).days / 7 / 52 for r in own[p][:step]]
        assert row["QUARTILE_ONE_AGE"] == pytest.approx(mean(ages), abs=.051)
        if x[step:]:
            assert row[f"FIRST_POST_{step}_WOBA_DIFF"] == half_up(mean(x[step:]) - mean(x[:step]), 3)
        gate = step
        first = row["FIRST_150_WOBA_GRADE" if role == "BAT" else "FIRST_215_WOBA_GRADE"]
        assert first == ("DNQ" if len(x) < gate else band(half_up(mean(x[:step]), 3), role == "PIT"))
    status = {p: got[p].PLAYER_STATUS for p in got}
    assert all(s is None for p, s in status.items() if p != "bat00")
    if role == "BAT":
        assert status["bat00"] == "ACTIVE"   # missing last game is filled with a later day
    else:
        assert got["pit03"].PITCHER_TYPE == "RELIEVER" and got["pit00"].PITCHER_TYPE == "STARTER"
        assert got["pit03"].POST_215_WOBA_GRADE_SP is None and got["pit00"].POST_215_WOBA_GRADE_NON_SP is None


def test_roles(league):
    got = {r.PLAYER_ID: r.PLAYER_TYPE for r in players.player_roles(players.measured(league["plays"])).collect()}
    assert (got["bat01"], got["pit01"], got["two00"], got["bat05"]) == ("Batter", "Pitcher", "Two-Way", "Batter")


@pytest.fixture(scope="module")
def built(spark, league):
    bat = players.batters(league["plays"], league["people"])
    pit = players.pitchers(league["plays"], league["people"])
    resolved = rankings.resolved_rankings(league["rankings"], league["people"], bat, pit, aliases={"bat 02": "BAT 02"}, id_by_name={}).cache()
    latest = rankings.ranking_at_debut(resolved)
    return {"resolved": resolved, "bat": players.batters(league["plays"], league["people"], latest).cache(),
            "pit": players.pitchers(league["plays"], league["people"], latest).cache()}


def test_rankings_resolve_and_attach(built):
    rows = {(r.PLAYER_NAME, r.YEAR.year): r for r in built["resolved"].collect()}
    assert rows["BAT00", 1995].ID == "bat00" and rows["PIT00", 1995].ID == "pit00"
    assert rows["BAT 02", 1996].ID == "bat02" and rows["Nobody", 1995].ID is None   # alias, then name parts; never found
    assert rows["BAT00", 1995].TEAM == "Red Sox"
    assert rows["BAT00", 1995].RANK_DEBUT_DATEDIFF_WKS == pytest.approx(-90 / 7)
    got = {r.BAT_ID: (r.PROSPECT_RANK, r.PROSPECT_RANK_GROUP, r.TOP_100_PROSPECT) for r in built["bat"].collect()}
    assert got["bat00"] == (1, "1 - 25", "Y") and got["bat05"] == (None, "Unranked", "N")
    assert got["bat02"] == (60, "51 - 75", "Y")


def test_refresh_and_debut_rates(spark, built):
    update = spark.createDataFrame([("new01", "No", "body", dt.date(2020, 8, 1))], "PLAYERID string, NICKNAME string, LAST string, PLAY_DEBUT date")
    out = rankings.refreshed_rankings(built["resolved"], update)
    assert out.count() == built["resolved"].count()   # ranked long before the refresh looks
    rate = {(r.rank_group, r.debuted): r.n for r in rankings.debut_rates(built["resolved"], pitchers=False).collect()}
    assert rate["76 - 100", "No"] == 1 and rate["Total", "Yes"] == 3
    assert {(r.rank_group, r.debuted): r.n for r in rankings.debut_rates(built["resolved"], pitchers=True).collect()}["Total", "Total"] == 1


def test_published_tables(built):
    bat = players.publish_players(built["bat"], "BAT")
    assert bat.columns[:4] == ["BAT_ID", "BAT_NAME", "BAT_DEBUT", "BAT_LASTGAME"] and len(bat.columns) == 30
    assert bat.columns.index("FIRST_150_WOBA") == 10 and bat.columns[-1] == "FIRST_POST_600_WOBA_DIFF"
    pit = players.publish_players(built["pit"], "PIT")
    assert len(pit.columns) == 37 and "pit02" not in {r.PIT_ID for r in pit.collect()}   # began too late


def test_reports(built):
    for role, df in ((reports.batter_role(), built["bat"]), (reports.starter_role(), built["pit"])):
        n = role.players(df).count()
        for m in (role.early, role.late):
            shares = reports.simple_grade_shares(df, role, m)
            assert shares.count() == 12 and shares.agg(F.sum("share")).first()[0] == pytest.approx(1)
            by_group = reports.simple_grade_shares(df, role, m, by_group=True)
            assert by_group.count() == 60
            ct = reports.grade_crosstabs(df, role, m)
            assert ct.filter(f"{m.first_grade} = 'Total' AND {m.post_grade} = 'Total'").agg(F.sum("n")).first()[0] == n
            reports.improved_share(df, role, m, "Poor", "Average").collect()
        assert reports.status_counts(df, role).agg(F.sum("n")).first()[0] == n
        assert reports.career_pyramid(df, role).agg(F.sum(F.abs("signed_n"))).first()[0] == role.players(df, role.density_total).count()
        for t in (reports.summary_table(df, role), reports.career_share(df, role), reports.top_players(df, role), reports.risers(df, role, role.early)):
            t.collect()
        assert len(reports.top_players_summary(df, role).collect()) == 1
        fit = reports.correlation(df, role, role.early.first, role.early.post).first()
        parts = reports.regression(df, role, role.early.first, role.early.post)
        assert fit.n == parts["points"].count() == (parts["line"].first().n or 0)
        assert parts["band"].count() == (80 if fit.n > 2 else 0)
    assert reports.movement_density(built["bat"], reports.batter_role(), reports.batter_role().early).count() % 512 == 0
    assert reports.career_density(built["bat"], reports.batter_role()).count() > 0


def test_game_endings(league):
    games = {}
    for r in sorted(league["rows"], key=lambda r: (r[3], r[0])):
        games.setdefault(r[1], []).append(r[14])
    want = {g for g, hits in games.items() if len(hits) > 1 and hits[-2:] == [4, 4]}
    assert {r.GAME_ID for r in reports.home_run_endings(league["plays"]).collect()} == want
    row = reports.home_run_ending_rate(league["plays"]).first()
    assert (row.n_total, row.n_hits) == (len(games), len(want))


def test_checks(spark, league):
    plays = league["plays"]
    assert checks.five_run_events(plays).count() == 1
    weights = spark.createDataFrame([(dt.date(y, 1, 1), .68, .7, .87, 1.24, 1.56, 1.9 + d) for y, d in ((1995, 0), (2000, .2), (2021, 9))], inputs.WEIGHTS)
    bad = checks.measure_violations(plays, weights)
    assert sorted(r.HIT_VAL for r in bad.collect()) == [1, 2, 3]   # .875, 1.25 and 1.5625 are above the largest weights
    assert checks.event_codes(plays).filter("prefix = 'S'").first().HIT_VAL == 1
    assert checks.event_codes(plays, 2, "S").first().prefix == "S7"
    assert checks.same_names(league["people"]).count() == 0
    assert checks.overused_ranks(league["rankings"]).count() == 0 and checks.ranking_duplicates(league["rankings"]).count() == 0
    board = spark.createDataFrame([(430, 100.0)], inputs.LEADERBOARD)
    assert checks.batters_faced_per_innings(board).first().per_50_innings == pytest.approx(215)


def test_fixed_values_are_consistent():
    assert len(ALIASES) == 48 and not any(a == b for a, b in ALIASES.items())
    assert len(CORRECTIONS) == 21


def test_unknown_pitch_counts(spark, league):
    """One unknown count leaves no mean; the innings then decide. Skipping takes the known ones."""
    plays = league["plays"].withColumn("PITCH_COUNT_FINAL", F.when(~((F.col("PIT_ID") == "pit00") & (F.col("INNING") == 9)), F.col("PITCH_COUNT_FINAL")))
    strict = {r.PIT_ID: r for r in players.pitchers(plays, league["people"]).collect()}
    loose = {r.PIT_ID: r for r in players.pitchers(plays, league["people"], null_policy="skip").collect()}
    assert (strict["pit00"].AVG_PIT_COUNT, strict["pit00"].PITCHER_TYPE) == (None, "OTHER")
    assert (loose["pit00"].AVG_PIT_COUNT, loose["pit00"].PITCHER_TYPE) == (90.0, "STARTER")
    assert strict["pit00"].FIRST_860_WOBA_GRADE_SP is None and strict["pit01"].PITCHER_TYPE == "STARTER"


def test_both_roles_from_two_scans_of_the_log(spark, league, tmp_path):
    league["plays"].write.parquet(str(tmp_path / "plays"))
    plays = spark.read.parquet(str(tmp_path / "plays"))

    assert players.role_totals(players.measured(plays))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    sums = players.career_sums(plays, league["people"])
    read = [line for line in sums._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "EVENT_WOBA" in line]
    assert len(read) == 1
    bat, pit = players.both(plays, league["people"])
    for together, alone in ((bat, players.batters(plays, league["people"])), (pit, players.pitchers(plays, league["people"]))):
        assert together.columns == alone.columns and sorted(map(str, together.collect())) == sorted(map(str, alone.collect()))
