"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from careerspark.llm import conversations
from careerspark.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Best (cost, audit) for each text of role initials' state, turn by turn, by trying every edit; rows are (role, text)."""
    seen, faults = set(), []
    for role, text in rows:
        kept = text.strip(SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))

    def extended(best):
        """With turns inserted: two are enough, as a third would come back to the same state."""
        out = dict(best)
        for _ in range(3):
            for said, (cost, audit, lines) in list(out.items()):
                for new in "ua":
                    put(out, said + new, cost + 2, audit + "I", [*lines, ({"u": "user", "a": "assistant"}[new], "")])
        return out

    def put(out, said, cost, audit, lines):
        if not re.fullmatch(r"s?(ua)*u?", said):
            return
        said = said if len(said) < 4 else said[:1].replace("u", "") + ("ua" if said[-1] == "a" else "uau")     # the same state
        if said not in out or (cost, audit) < out[said][:2]:
            out[said] = (cost, audit, lines)

    best = extended({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        after = {}
        for said, (cost, audit, lines) in best.items():
            put(after, said, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role:
                put(after, said + role[0], cost + extra, audit + "K", [*lines, (role, text)])
            for new in ("user", "assistant"):
                put(after, said + new[0], cost + 2 + extra, audit + "R", [*lines, (new, text)])
        best = extended(after)
    cost, audit, lines = min(v for k, v in best.items() if re.fullmatch(r"(s?(ua)+)?", k))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))


def plain(rows):
    out = {}
    for conv, run in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        out[conv] = plain_repair([(" " if r is None else r, " " if t is None else t) for _, _, r, t in in_order(run)])
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ulf"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why? ", "again.", "é。"]
    rows = [(c, rnd.choice([None, *range(t + 2)]) if c % 3 == 0 else t, rnd.choice(roles), rnd.choice(texts))
            for c in range(150) for t in range(rnd.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)]
    rows += [(501, t, rnd.choice(roles), rnd.choice([f"turn {t}.", f"turn {t}", "same.", ""])) for t in range(90)]
    rows += [(502, t, "tool", f"{t}!") for t in range(33)]
    rows += [(None, t, "user", f"{t}!") for t in range(3)] + [(503, 1, "user", "same")] * 30 + [(504, 0, "user", "long " * 60_000 + ".")]
    return rows


@pytest.mark.parametrize("piece, fan", [(512, 32), (4, 3), (1, 2)])
def test_against_a_plain_search(spark, rows, monkeypatch, piece, fan):
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "FAN", fan)
    turns = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "conv_id long, turn long, role string, text string, piece string, audit string, _at int").repartition(5)
    got = conversations.digest(conversations.repair(turns)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})


def test_conversations_too_large_for_a_task(spark, rows, monkeypatch):
    from careerspark.operators.skew import MAX_GROUP_ROWS_CONF
    monkeypatch.setattr(conversations, "PIECE", 8)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set(MAX_GROUP_ROWS_CONF, "25")
    try:
        got = conversations.digest(conversations.repair(turns)).collect()
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_CONF)
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.digest(conversations.repair(none)).count() == 0


def test_query_repairs_the_damaged_table(spark):
    folder = "/root/testdata/sf0.001"
    original = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for conv, turn, role, text in original:
        fate = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            damaged += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    want = plain(damaged)
    out = {r.conv_id: r for r in QUERIES["op11_lightest_repair"](spark, folder).collect()}
    assert out.keys() == {r[0] for r in original}
    for conv, r in out.items():
        turns = [t for c, t, _, _ in damaged if c == conv]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (
            gaps, *want.get(conv, (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())))


def test_gaps(spark):
    rows = [(1, 5), (1, 9), (1, 9), (1, None), (2, None), (3, -(1 << 63)), (3, (1 << 63) - 1)]
    out = spark.createDataFrame(rows, "c int, t long").groupBy("c").agg(conversations.gaps(F.col("t")).alias("g")).collect()
    assert {r.c: r.g for r in out} == {1: 3, 2: 0, 3: None}
