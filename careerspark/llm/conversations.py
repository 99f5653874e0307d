"""Repair of conversations as a lightest derivation.

A conversation is right when its roles are nothing, or an optional system turn and then user and assistant in turn, ending
with the assistant. Items are (turns read, state of that grammar); each edit of a turn is a deduction from one item to
another with a cost and a letter: Keep (0), Rerole to the role that is due (2), Delete (3, the only edit of a blank or
repeated turn), Insert an empty turn of the role that is due (2); a truncated turn that stays costs 1 more. An agenda
pops items by (cost, letters so far), and the first goal item popped is final: a deduction never makes this pair smaller
(superior), and of two ways to one item the smaller stays the smaller under any continuation (monotone), because among
ways that have read the same turns the letters fix the cost, so none of equal cost goes on from another.

Conversations are cut into pieces of at most PIECE turns, so no task holds a whole one. A piece of a longer conversation gives
the lightest way from each state to each state; these are deductions themselves, and the same agenda combines FAN of them at
a time, as often as needed. Only the last step, which puts a conversation's audit and digest together, reads its pieces
one after another in one task, since a digest is one stream; it holds one piece and the audit at a time.

Results of odd rows: a missing role or text is one space; turns without a number come first, and those with equal numbers
follow by role and text, which makes equal rows adjacent; a missing conv_id is a conversation of its own; a role that is
empty starts with nothing and can be deleted or changed, not kept; texts of any length are only looked at by Spark's
functions and copied, 512 at a time. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.sequence import annotate
from ..operators.skew import oversized
from .common import saved

PIECE = 512         # turns
FAN = 32            # pieces that are combined at once
SPACE = "\t\n\x0b\x0c\r "
#: What may follow in each state, by role initial: nothing yet; after system; after user; after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
GOALS = (0, 3)
FAULTS = ("", "blank", "duplicate", "truncated")

Item = tuple[int, int]
Way = tuple[int, str, tuple]


def lightest(start: Item, deductions: Callable[[Item], Iterable[tuple[int, str, tuple, Item]]], last: int, first_goal: bool) -> dict[int, Way]:
    """The lightest ways from an item to the states after ``last`` steps, or only the one to the goal.

    ``deductions`` gives cost, letters, marks and item of each deduction; marks are handed on.
    """
    agenda, done, found = [(0, "", start, ())], set(), {}
    while agenda:
        cost, audit, item, marks = heapq.heappop(agenda)
        if item in done:
            continue
        done.add(item)
        if item[0] == last and (not first_goal or item[1] in GOALS):
            found[item[1]] = (cost, audit, marks)
            if first_goal or len(found) == len(NEXT):
                break
        for more, letters, mark, then in deductions(item):
            if then not in done:
                heapq.heappush(agenda, (cost + more, audit + letters, then, marks + mark))
    return found


def edits(initials: list[str], faults: list[int]) -> Callable[[Item], Iterator[tuple[int, str, tuple, Item]]]:
    def of(item: Item) -> Iterator[tuple[int, str, tuple, Item]]:
        i, state = item
        due = NEXT[state][DUE[state]]
        yield 2, "I", (), (i, due)
        if i < len(initials):
            yield 3, "D", (), (i + 1, state)
            fault = faults[i]
            if fault not in (1, 2):
                extra = 1 if fault == 3 else 0
                kept = NEXT[state].get(initials[i])
                if kept is not None:
                    yield extra, "K", (), (i + 1, kept)
                yield 2 + extra, "R", (), (i + 1, due)
    return of


def replayed(state: int, audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns that the edits leave."""
    out, at = [], iter(turns)
    for letter in audit:
        if letter == "I":
            out.append((ROLES[DUE[state]], ""))
            state = NEXT[state][DUE[state]]
            continue
        role, text = next(at)
        if letter == "K":
            out.append((role, text))
            state = NEXT[state][role[:1]]
        elif letter == "R":
            out.append((ROLES[DUE[state]], text))
            state = NEXT[state][DUE[state]]
    return out


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


TURNS = "array<struct<role string, text string>>"
ARCS = "array<struct<start int, end int, cost long, audit string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_ARC = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first columns."""
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
    for key, run in groupby(rows, key=lambda r: r[:keys]):
        yield key, run


def _batched(schema: pa.Schema, rows: Iterable[tuple], size: int = 2_000, weight: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, closed after so many rows or about so many signs; the last value of a row is its weight."""
    held, heavy = [], 0
    for row in rows:
        held.append(row[:-1])
        heavy += row[-1]
        if len(held) >= size or heavy >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _key_type(df: DataFrame) -> StructField:
    return df.schema["conv_id"]


def _schema(key: StructField, *columns: str) -> StructType:
    rest = StructType.fromDDL(", ".join(columns))
    return StructType([key, *rest.fields])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pieces_of(turns: DataFrame) -> DataFrame:
    """Pieces of conversations: counts of faults, role initials at both ends, ways (arcs) and turns.

    A conversation of one piece has its only way and its repaired turns; others all ways and the turns as they came.
    """
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").alias("_turn"), F.coalesce(F.col("role").cast("string"), blank).alias("_role"),
                        F.coalesce(F.col("text").cast("string"), blank).alias("_text"), F.col("turn").isNotNull().alias("_known"))
    heavy = oversized(rows, "conv_id")
    numbered = annotate(rows, "conv_id", ["_known", "_turn", "_role", "_text"], number="_at", size="_size", heavy=heavy)
    again = F.row_number().over(Window.partitionBy("conv_id", "_role", "_text").orderBy("_at")) > 1
    last = F.substring(F.rtrim(F.col("_text"), F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    cut = numbered.select("conv_id", F.floor((F.col("_at") - 1) / PIECE).cast("int").alias("_piece"),
                          F.ceil(F.col("_size") / PIECE).cast("int").alias("_pieces"), "_at", fault.cast("int").alias("_fault"), "_role", "_text")
    if heavy is not None:       # otherwise conversations are whole within partitions already
        cut = cut.repartition("conv_id", "_piece")
    key = _key_type(cut)
    schema = _schema(key, "piece int, pieces int, blank long, duplicate long, truncated long, illegal long, first string, last string",
                     f"arcs {ARCS}, turns {TURNS}")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out() -> Iterator[tuple]:
            for (conv_id, piece, pieces), run in _grouped(batches, 3):
                _, _, _, _, faults, roles, texts = map(list, zip(*run))
                initials = [r[:1] for r in roles]
                deductions, turns = edits(initials, faults), list(zip(roles, texts))
                if pieces == 1:
                    (end, (cost, audit, _)), = lightest((0, 0), deductions, len(turns), True).items()
                    arcs, turns = [(0, end, cost, audit)], replayed(0, audit, turns)
                else:
                    arcs = [(start, end, cost, audit) for start in range(len(NEXT) if piece else 1)
                            for end, (cost, audit, _) in lightest((0, start), deductions, len(turns), False).items()]
                yield (conv_id, piece, pieces, *(faults.count(k) for k in (1, 2, 3)), sum(not legal(a, b) for a, b in zip(initials, initials[1:])),
                       initials[0], initials[-1], [dict(zip(("start", "end", "cost", "audit"), a)) for a in arcs],
                       [{"role": r, "text": t} for r, t in turns], sum(map(len, texts)) + 1000)
        yield from _batched(arrow, rows_out())

    return cut.sortWithinPartitions("conv_id", "_piece", "_at").mapInArrow(run, schema)


def _chosen(pieces: DataFrame) -> DataFrame:
    """The way through each piece of the longer conversations: conv_id, piece, start, cost, audit."""
    key = _key_type(pieces)
    marks = "array<struct<start int, cost long, letters int>>"
    schema = _schema(key, f"piece int, start int, end int, cost long, audit string, marks {marks}")
    arrow = _arrow(schema)
    arcs = pieces.select("conv_id", "piece", F.inline("arcs")).withColumn(
        "marks", F.array(F.struct("start", "cost", F.length("audit").alias("letters"))))

    def combined(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows_out() -> Iterator[tuple]:
                for (conv_id, group), rows in _grouped(batches, 2):
                    ways: dict[Item, list] = {}
                    order: dict[int, int] = {}
                    for _, _, piece, start, end, cost, audit, mark in rows:
                        at = order.setdefault(piece, len(order))
                        ways.setdefault((at, start), []).append((cost, audit, tuple(map(tuple, (m.values() for m in mark))), (at + 1, end)))
                    for start in sorted({s for at, s in ways if at == 0}):
                        found = lightest((0, start), lambda item: ways.get(item, ()), len(order), last)
                        for end, (cost, audit, mark) in found.items():
                            yield (conv_id, group, start, end, cost, audit, [dict(zip(("start", "cost", "letters"), m)) for m in mark], len(audit) + 100)
            yield from _batched(arrow, rows_out())
        return run

    most = pieces.agg(F.max("pieces")).first()[0] or 1
    while True:
        last = most <= FAN
        grouped = arcs.select("conv_id", F.floor(F.col("piece") / FAN).cast("int").alias("_group"), "piece", "start", "end", "cost", "audit", "marks")
        arcs = grouped.repartition("conv_id", "_group").sortWithinPartitions("conv_id", "_group", "piece", "start", "end").mapInArrow(combined(last), schema)
        if last:
            break
        arcs, most = saved(arcs, "conversation-ways"), -(-most // FAN)
    whole = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = arcs.select("conv_id", "audit", F.posexplode("marks").alias("piece", "mark")).withColumn("before", F.coalesce(F.sum("mark.letters").over(whole), F.lit(0)))
    return placed.select("conv_id", "piece", "mark.start", "mark.cost", F.expr("substring(audit, cast(before as int) + 1, mark.letters)").alias("audit"))


def repair(turns: DataFrame) -> DataFrame:
    """Repairs conversations, given as rows of conv_id, turn, role and text.

    Returns one row per piece of a conversation (piece counts from 0): conv_id, piece, pieces, blank, duplicate, truncated,
    illegal (neighbours within the piece), first and last (role initials), cost, audit (a letter per edit: K, R, D or I) and
    turns, the repaired ones.
    """
    pieces = saved(pieces_of(turns), "conversation-pieces")
    one = F.col("arcs")[0]
    short = pieces.filter("pieces = 1").select("conv_id", "piece", "pieces", *COUNTS, "first", "last", one["cost"].alias("cost"), one["audit"].alias("audit"), "turns")
    long = pieces.filter("pieces > 1")
    if long.isEmpty():
        return short
    ways = _chosen(long).withColumnsRenamed({"conv_id": "_conv", "piece": "_piece"})
    met = long.drop("arcs").join(ways, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece"))).select(
        "conv_id", "piece", "pieces", *COUNTS, "first", "last", "cost", "audit", "start", "turns")
    schema = short.schema
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((*r[:-2], [{"role": a, "text": b} for a, b in replayed(r[-2], r[-3], [(t["role"], t["text"]) for t in r[-1]])],
                     sum(len(t["text"]) for t in r[-1])) for r in zip(*[c.to_pylist() for c in batch.columns]))
            yield from _batched(arrow, rows)

    return short.unionByName(met.mapInArrow(run, schema))


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result: conv_id, the counts, cost, audit and repaired_sha256, the digest of the
    repaired turns as role:text, one per line."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    fields = ["conv_id", *COUNTS, "cost", "audit"]
    short = repaired.filter("pieces = 1").select(*fields, F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    long = repaired.filter("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(
        "conv_id", *COUNTS, "cost", "first", "last", "audit", F.array_join(lines, "\n").alias("_lines"), (F.size("turns") > 0).alias("_some"))
    schema = short.schema
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out() -> Iterator[tuple]:
            for (conv_id,), rows in _grouped(batches, 1):
                sums, audits, sha, before, begun = [0] * 5, [], hashlib.sha256(), None, False
                for _, *counts, first, last, audit, text, some in rows:
                    sums = [a + b for a, b in zip(sums, counts)]
                    if before is not None and not legal(before, first):
                        sums[3] += 1
                    before = last
                    audits.append(audit)
                    if some:
                        sha.update(("\n" * begun + text).encode("utf-8", "surrogatepass"))
                        begun = True
                yield (conv_id, *sums, "".join(audits), sha.hexdigest(), 1000)
        yield from _batched(arrow, rows_out())

    return short.unionByName(long.mapInArrow(run, schema))


def gaps(turn: Column) -> Column:
    """An aggregate: turn numbers that are missing between the least and the greatest; missing for spans over 64 bits."""
    wide = [f(turn).cast("decimal(20,0)") for f in (F.max, F.min)]
    return F.coalesce((wide[0] - wide[1] + 1 - F.count_distinct(turn)), F.lit(0)).try_cast("long")
