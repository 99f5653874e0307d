"""Corpus counts of word sequences without a row per occurrence.

Texts are stored once as batches of word hashes (``encoded``). Each batch then asks for its distinct keys, split into
parts by hash; a part adds up what all batches sent and answers each batch in the order of its keys (``counted``);
the answers are joined to the batches (``answered``). A key sends at most one entry per batch, so a sequence that
stands in a third of all texts weighs no more than any other, and every part gets the same share of each batch.

A batch splits its keys into at most FAN ranges, so an entry holds thousands of keys and entries grow with the corpus, not
with its square. Where more parts are needed, the entries of up to GROUP batches in one range are merged first, and the merged
ones split up that range in the same way, as often as needed; answers come back along the same groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, pack, pack_sorted, saved, slices, text_bytes, unpack, unpack_sorted, word_hashes

BATCH_WORDS = 1_200_000         # words of a batch; it closes with the chunk of texts that reaches them
PART_KEYS = 1_500_000           # keys that a task adds up at once, about
FAN = 512                       # ranges into which keys are split at once
GROUP = 256                     # entries of one range that are merged at once, about

ENCODED = "batch long, side int, n_words long, doc_ids array<long>, flags array<int>, lengths binary, vocabulary binary, words binary"


def encoded(texts: DataFrame, name: str) -> DataFrame:
    """Batches of texts as word hashes, written to the shared folder.

    ``texts`` has doc_id long, text, flag int (kept per text) and side int (texts of different sides share no batch).
    """
    columns = texts.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
                           F.col("flag").cast("int"), F.col("side").cast("int"))
    return saved(columns.mapInArrow(_encode, ENCODED), name)


class _Batch:
    def __init__(self):
        self.ids, self.flags, self.lengths, self.words, self.size = [], [], [], [], 0


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_batches: dict[int, _Batch] = {}
    number = TaskContext.get().partitionId() << 32

    def close(side: int) -> pa.RecordBatch:
        nonlocal number
        b = open_batches.pop(side)
        vocabulary, words = np.unique(np.concatenate(b.words), return_inverse=True)
        number += 1
        return pa.RecordBatch.from_arrays([
            pa.array([number - 1], pa.int64()), pa.array([side], pa.int32()), pa.array([b.size], pa.int64()),
            pa.array([np.concatenate(b.ids).tolist()], pa.list_(pa.int64())),
            pa.array([np.concatenate(b.flags).tolist()], pa.list_(pa.int32())),
            pa.array([pack(narrow(np.concatenate(b.lengths)))]), pa.array([pack_sorted(vocabulary)]),
            pa.array([pack(narrow(words))])],
            names=["batch", "side", "n_words", "doc_ids", "flags", "lengths", "vocabulary", "words"])

    for batch in batches:
        sides = batch.column(3).to_numpy(zero_copy_only=False)
        for side in np.unique(sides):
            rows = batch.filter(pa.array(sides == side))
            data, offsets = text_bytes(rows.column(1))
            ids = np.array(rows.column(0).to_pylist(), dtype=object)
            flags = rows.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                words, lengths = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                b = open_batches.setdefault(int(side), _Batch())
                b.ids.append(ids[i:j])
                b.flags.append(flags[i:j])
                b.lengths.append(lengths)
                b.words.append(words)
                b.size += len(words)
                if b.size >= BATCH_WORDS or sum(map(len, b.ids)) >= BATCH_WORDS:
                    yield close(int(side))
    for side in list(open_batches):
        yield close(side)


def decoded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch, and the words of each of its texts."""
    vocabulary = unpack_sorted(row["vocabulary"])
    words = unpack(row["words"])
    return vocabulary[words] if len(words) else np.zeros(0, np.uint64), unpack(row["lengths"]).astype(np.int64)


# Keys of a batch: for each kind of key, the sorted distinct keys and one count column per counter.
KeysOf = Callable[[dict], list[tuple[np.ndarray, list[np.ndarray]]]]


def counted(batches: DataFrame, keys_of: KeysOf, name: str, kinds: int = 1, keys_per_word: float = 1.0) -> DataFrame:
    """Sums of each counter over all batches, for each key of each batch: written to the shared folder.

    Columns: batch, kind, part, sums (one packed array per counter, in the order of the batch's keys of that part)
    and stats: on one row per part, the number of keys with a positive sum and the sum, for each counter.
    """
    n_words = batches.agg(F.sum("n_words")).first()[0] or 0
    parts = max(4, int(n_words * keys_per_word // PART_KEYS) + 1)
    ranges = min(parts, FAN)

    def request(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                entries = [(row["batch"], kind, kind * ranges, keys, counters) for kind, (keys, counters) in enumerate(keys_of(row))]
                yield from _split(entries, 1, ranges)

    asked = batches.mapInArrow(request, ASKED)
    sums = _sums(asked, ranges, -(-parts // ranges), batches.count() if parts > ranges else 0, name)
    return saved(sums, name)


ASKED = "batch long, kind int, part long, keys binary, counters array<binary>"
SUMS = "batch long, kind int, part long, sums array<binary>, stats array<long>"


def _split(entries: list[tuple], ranges: int, fan: int) -> Iterator[pa.RecordBatch]:
    """Entries of (batch, kind, first part, sorted keys, counters), each of one of ``ranges`` ranges of all keys, as entries of a
    ``fan``-th of it. Parts of a kind are numbered in the order of their ranges."""
    out = []
    for batch, kind, first, keys, counters in entries:
        at = first % (ranges * fan)
        edges = np.array([((at + s) << 64) // (ranges * fan) for s in range(1, fan)], np.uint64)
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for s, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                out.append((batch, kind, first + s, pack_sorted(keys[i:j]), [pack(narrow(c[i:j])) for c in counters]))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())))],
            names=["batch", "kind", "part", "keys", "counters"])


def _sums(asked: DataFrame, ranges: int, splits: int, n_batches: int, name: str) -> DataFrame:
    """Answers to entries of ``ranges`` ranges, each of which has to be split ``splits`` times more."""
    if splits <= 1:
        return asked.groupBy("part").applyInArrow(_add_up, SUMS)
    groups, fan = max(1, -(-n_batches // GROUP)), min(splits, FAN)
    grouped = saved(asked.withColumn("_group", F.col("part") * groups + F.pmod(F.xxhash64("batch"), F.lit(groups))), f"{name}-asked")

    def finer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                # Part p of a kind becomes parts p * fan and following; a kind has ranges * fan of them.
                yield from _split([(r["batch"], r["kind"], r["part"] * fan, unpack_sorted(r["keys"]), [unpack(c).astype(np.int64) for c in r["counters"]])], ranges, fan)

    merged = grouped.groupBy("_group").applyInArrow(_merge, ASKED)
    answers = saved(_sums(merged.mapInArrow(finer, ASKED), ranges * fan, -(-splits // fan), groups, name), f"{name}-merged")
    back = grouped.groupBy("_group").cogroup(answers.filter("sums is not null").withColumn("_group", F.col("batch")).groupBy("_group")).applyInArrow(_hand_back, SUMS)
    # Totals come from the last split alone.
    nothing = [F.lit(None).cast("long").alias("batch"), "kind", "part", F.lit(None).cast("array<binary>").alias("sums"), "stats"]
    return back.unionByName(answers.filter("stats is not null").select(*nothing))


def _entries(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Distinct keys of some entries, where each key of each entry is among them, where entries start, and their counters."""
    keys = [unpack_sorted(b) for b in asked.column("keys").to_pylist()]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, where, np.cumsum([0, *map(len, keys)]), asked.column("counters").to_pylist()


def _merge(asked: pa.Table) -> pa.Table:
    """One entry for those of a group, named by the group."""
    distinct, where, _, counters = _entries(asked)
    sums = []
    for c in range(len(counters[0])):
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, np.concatenate([unpack(x[c]).astype(np.int64) for x in counters]))
        sums.append(pack(narrow(total.astype(np.uint64))))
    return pa.table({"batch": asked.column("_group").slice(0, 1), "kind": asked.column("kind").slice(0, 1), "part": asked.column("part").slice(0, 1),
                     "keys": pa.array([pack_sorted(distinct)], pa.binary()), "counters": pa.array([sums], pa.list_(pa.binary()))})


def _hand_back(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to the merged entry, handed to the entries of its group in the order of their keys."""
    distinct, where, starts, counters = _entries(asked)
    order = np.argsort(answers.column("part").to_numpy(), kind="stable")
    lists = answers.column("sums").to_pylist()
    sums = [[] for _ in range(asked.num_rows)]
    for c in range(len(counters[0])):
        total = np.concatenate([unpack(lists[k][c]) for k in order])[where]
        for k, (i, j) in enumerate(zip(starts, starts[1:])):
            sums[k].append(pack(narrow(total[i:j])))
    return pa.table({"batch": asked.column("batch"), "kind": asked.column("kind"), "part": asked.column("part"),
                     "sums": pa.array(sums, pa.list_(pa.binary())), "stats": pa.array([None] * asked.num_rows, pa.list_(pa.int64()))})


def _add_up(asked: pa.Table) -> pa.Table:
    """Sums of the keys of a part, for each entry, and the part's totals on the first row."""
    distinct, where, sizes, counters = _entries(asked)
    answers, stats = [], []
    for c in range(len(counters[0])):
        sent = np.concatenate([unpack(x[c]).astype(np.int64) for x in counters])
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, sent)
        stats += [int((total > 0).sum()), int(total.sum())]
        back = total[where].astype(np.uint64)
        answers.append([pack(narrow(back[i:j])) for i, j in zip(sizes, sizes[1:])])
    rows = asked.num_rows
    return pa.table({
        "batch": asked.column("batch"), "kind": asked.column("kind"), "part": asked.column("part"),
        "sums": pa.array([list(x) for x in zip(*answers)], pa.list_(pa.binary())),
        "stats": pa.array([stats, *[None] * (rows - 1)], pa.list_(pa.int64()))})


def answered(batches: DataFrame, sums: DataFrame) -> DataFrame:
    """Each batch with its answers; ``sums_of`` reads them."""
    lists = sums.groupBy(F.col("batch").alias("_batch")).agg(
        F.collect_list(F.struct("kind", "part", "sums")).alias("answers"))
    return batches.join(lists, F.col("batch") == F.col("_batch"), "left").drop("_batch")


def sums_of(row: dict, kind: int) -> list[np.ndarray]:
    """Sums for the keys of one kind of a batch, one array per counter, in the order of the keys."""
    own = sorted((a for a in row["answers"] or [] if a["kind"] == kind), key=lambda a: a["part"])
    if not own:
        return []
    return [np.concatenate([unpack(a["sums"][c]).astype(np.int64) for a in own]) for c in range(len(own[0]["sums"]))]
