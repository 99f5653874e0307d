"""Exact ranked lexical search with sparse ball trees.

A document is a sparse vector: for each term that some item asks for, what the term adds to a score. An item is the set of
its terms, and a score is an inner product of the two. Documents are gathered into trees of up to TREE_ROWS rows. A node
knows the centre of its documents and the largest distance of one from it; no document in it can score more than the
centre does plus that distance times the length of the item's vector. An item goes through the nodes of a tree in the order of
these bounds and stops at the first that lies below its k-th score so far. Leaves score in whole numbers. Centres, distances and
bounds are doubles, rounded up by more than their error (``SLACK``), so a bound never excludes a document that counts; a
bound equal to the k-th score excludes nothing either, since ties are settled by doc_id.

Items are a stated set of queries: they are searched in blocks of about ``BLOCK_TERMS`` terms, each against all documents.
The trees of a task share the best scores, and each task returns at most k rows an item.

Results of odd rows: a null or empty text, and a document without a term, counts as no document and is never found; items
without terms have no result; of items that repeat an item_id the one with the smallest text counts (nulls are one id);
documents that repeat a doc_id are ranked each, rows without doc_id after others of equal score; a text of any length is read
whole, in slices of READ bytes. Extra columns are not read. Tables without rows give no result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved, text_bytes

TREE_ROWS = 4_096
LEAF_ROWS = 64
CELLS = 4_000_000           # entries of a tree's rows, and numbers in its centres, at most (but for a single row)
BLOCK_TERMS = 100_000       # terms of the items that are searched at once; the last item may exceed it
READ = 1 << 20              # bytes of a text whose terms are held at once
SLACK = 1e-9                # relative; sums of 10^5 doubles err by less than 10^5 * 2^-53, about 10^-11
#: Bytes as parts of terms: digits, letters in lower case and all beyond ASCII; others divide terms.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def slices_of_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    if len(text) <= READ:
        yield text.translate(TERM).split()
        return
    start = 0
    while start < len(text):
        end = start + READ
        part = text[start:end].translate(TERM)
        while end < len(text) and part[-1:] != b" ":         # to the end of a term
            more = text[end:end + READ].translate(TERM)
            stop = more.find(b" ")
            part, end = (part + more, end + len(more)) if stop < 0 else (part + more[:stop + 1], end + stop + 1)
        yield part.split()
        start = end


def terms_of(text: bytes) -> set[bytes]:
    return {t for part in slices_of_terms(text) for t in part}


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and the distinct terms of each item that has any, saved."""
    one = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).groupBy("item_id").agg(F.min("_text").alias("_text"))
    schema = one.select("item_id", F.lit(None).cast("array<binary>").alias("terms")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms_of(t.encode("utf-8", "surrogatepass"))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    return saved(one.mapInArrow(run, schema).filter(F.size("terms") > 0), "ranked-items")


VECTORS = "n long, terms array<int>, times array<long>"


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms), and how often each term of the vocabulary occurs; rows without any term are left out."""
    fields = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)      # at most BLOCK_TERMS terms, or those of one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        known = number.keys()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            whole = data.tobytes()
            n, terms, times = [], [], []
            for i, j in zip(offsets.tolist(), offsets[1:].tolist()):
                size, counts = 0, Counter()
                for part in slices_of_terms(whole[i:j]):
                    size += len(part)
                    counts.update(filter(known.__contains__, part))
                n.append(size)
                terms.append([number[t] for t in counts])
                times.append(list(counts.values()))
            some = np.array(n, np.int64) > 0
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                                             names=["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(some))

    return saved(fields.mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, {VECTORS}"), "ranked-vectors")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def parts_of_scores(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a weight is multiplied with, in documents of ``n`` terms; all in whole numbers."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 62:
        m = 10 + 90 * n * n_docs // n_terms
    else:
        m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """A ball tree over sparse rows of whole numbers, built a level at a time.

    Row r has ``values`` at ``columns`` in ``starts[r]`` to ``starts[r + 1]``, at least one. Each node is halved along the
    line between two far rows, down to ``leaf_rows`` rows. Nodes are numbered from the root, level by level.
    """

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf_rows: int = LEAF_ROWS):
        rows = len(starts) - 1
        row, x = np.repeat(np.arange(rows), np.diff(starts)), values.astype(np.float64)
        norm = np.bincount(row, x * x, rows)
        order = np.arange(rows)
        self.spans, self.children = [(0, rows)], {}
        centres, radii, level = [], [], [0]
        while level:
            sizes = np.array([b - a for a, b in (self.spans[n] for n in level)])
            members = np.concatenate([order[slice(*self.spans[n])] for n in level])
            first = np.cumsum(sizes) - sizes
            of = np.full(rows, -1)
            of[members] = np.repeat(np.arange(len(level)), sizes)
            here = of[row] >= 0
            r, c, v = row[here], columns[here], x[here]
            at = of[r]

            def distances(points: np.ndarray, squares: np.ndarray) -> np.ndarray:
                """Squared distance of each member to its node's point."""
                return (norm - 2 * np.bincount(r, v * points[at, c], rows))[members] + np.repeat(squares, sizes)

            def farthest(away: np.ndarray) -> np.ndarray:
                return members[np.lexsort((away, of[members]))[first + sizes - 1]]

            def dense(some: np.ndarray) -> np.ndarray:
                """One row of each node, written out."""
                place = np.full(rows, -1)
                place[some] = np.arange(len(some))
                mine = place[r] >= 0
                out = np.zeros((len(level), width))
                out[place[r[mine]], c[mine]] = v[mine]
                return out

            centre = np.bincount(at * width + c, v, len(level) * width).reshape(len(level), width) / sizes[:, None]
            square = (centre ** 2).sum(axis=1)
            away = distances(centre, square)
            error = SLACK * (np.maximum.reduceat(norm[members], first) + square)       # a difference of large numbers
            centres.append(centre)
            radii.append(np.sqrt(np.maximum(np.maximum.reduceat(away, first), 0) + error))
            if (sizes <= leaf_rows).all():
                break
            a = farthest(away)
            from_a = dense(a)
            b = farthest(distances(from_a, norm[a]))
            along = np.bincount(r, v * (dense(b) - from_a)[at, c], rows)[members]
            halved = members[np.lexsort((along, of[members]))]
            below = []
            for k, n in enumerate(level):
                start, end = self.spans[n]
                order[start:end] = halved[first[k]:first[k] + sizes[k]]
                if sizes[k] > leaf_rows:
                    middle, number = (start + end) // 2, len(self.spans)
                    self.children[n] = (number, number + 1)
                    self.spans += [(start, middle), (middle, end)]
                    below += [number, number + 1]
            level = below
        self.centres, self.radii, self.order = np.concatenate(centres), np.concatenate(radii), order
        lengths = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        entries = np.repeat(starts[:-1][order] - self.starts[:-1], lengths) + np.arange(len(values))
        self.columns, self.values = columns[entries], values[entries]
        self.wanted = np.zeros(width, bool)

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each node, at least the score of every row in it."""
        return (self.centres[:, terms].sum(axis=1) + np.sqrt(len(terms)) * self.radii) * (1 + SLACK)

    def search(self, terms: np.ndarray, ids: list, best: list, k: int) -> int:
        """Adds to ``best``, a heap of the k best (score, reversed id), what of this tree belongs there. Returns the leaves read."""
        bounds = self.bounds(terms)
        agenda, read = [(-bounds[0], 0)], 0
        self.wanted[terms] = True
        while agenda:
            least = best[0][0] if len(best) == k else 1
            bound, node = heapq.heappop(agenda)
            if -bound < least:
                break
            if node in self.children:
                for child in self.children[node]:
                    heapq.heappush(agenda, (max(bound, -bounds[child]), child))
                continue
            read += 1
            first, last = self.spans[node]
            start, end = self.starts[first], self.starts[last]
            scores = np.add.reduceat(self.values[start:end] * self.wanted[self.columns[start:end]], self.starts[first:last] - start)
            for at in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[at]), Last(ids[self.order[first + at]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif best[0] < entry:
                    heapq.heapreplace(best, entry)
        self.wanted[terms] = False
        return read


class Last:
    """An id in reversed order: the greatest is the one that is ranked last, a missing id before all."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: Last) -> bool:
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return self.value == other.value


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The k documents with the highest scores above 0 for each item: item_id, rank (from 1), doc_id, score."""
    asked = _items(items, item_id, text)
    ids = {"item_id": asked.schema["item_id"].dataType, "doc_id": docs.schema[doc_id].dataType}
    schema = StructType([StructField("item_id", ids["item_id"]), StructField("doc_id", ids["doc_id"]), StructField("score", LongType())])
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(asked):
        found = found.unionByName(_found(docs, block, k, doc_id, text, schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(asked: DataFrame) -> Iterator[list[tuple]]:
    """Items with their terms, so many that the driver holds about BLOCK_TERMS terms."""
    block, size = [], 0
    for r in asked.toLocalIterator():
        block.append((r["item_id"], list(map(bytes, r["terms"]))))
        size += len(r["terms"])
        if size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(docs: DataFrame, block: list[tuple], k: int, doc_id: str, text: str, schema: StructType) -> DataFrame:
    """The best documents that each task finds for each item of a block."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    vectors = _vectors(docs, vocabulary, doc_id, text)
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():    # a row per term of the block
        df[r["t"]] = r["n"]
    shipped = docs.sparkSession.sparkContext.broadcast(
        (weights(df, n_docs), [i for i, _ in block], [np.array([vocabulary[t] for t in terms]) for _, terms in block]))
    n_rows = min(TREE_ROWS, max(LEAF_ROWS, CELLS * LEAF_ROWS // (4 * len(vocabulary))))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, item_ids, items = shipped.value
        best: list[list] = [[] for _ in items]
        place = np.full(len(weight), -1)
        for ids, n, starts, terms, tf in _trees(batches, n_rows):
            used, columns = np.unique(terms, return_inverse=True)       # the terms of these documents alone
            values = weight[terms] * parts_of_scores(tf, np.repeat(n, np.diff(starts)), n_docs, n_terms)
            tree = Tree(starts, columns, values, len(used))
            place[used] = np.arange(len(used))
            for i, t in enumerate(items):
                own = place[t]
                own = own[own >= 0]
                if len(own):
                    tree.search(own, ids, best[i], k)
            place[used] = -1
        rows = [(item_ids[i], e[1].value, e[0]) for i, heap in enumerate(best) for e in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, schema)


def _trees(batches: Iterator[pa.RecordBatch], n_rows: int) -> Iterator[tuple]:
    """ids, n, starts, terms and times of so many rows at a time as make a tree."""
    held, rows, entries = [], 0, 0

    def closed() -> tuple:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = whole.column(2).chunk(0) if whole.num_rows else None
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        return whole.column(0).to_pylist(), whole.column(1).to_numpy(), starts, lists.flatten().to_numpy(), whole.column(3).chunk(0).flatten().to_numpy()

    for batch in batches:
        lengths = batch.column(2).value_lengths().to_numpy()
        first = 0
        while first < batch.num_rows:
            total = entries + np.cumsum(lengths[first:first + n_rows - rows])
            take = max(int(np.searchsorted(total, CELLS, side="right")), 0 if rows else 1)
            held.append(batch.slice(first, take))
            rows, entries, first = rows + take, int(total[take - 1]) if take else entries, first + take
            if rows >= n_rows or take < len(total):
                yield closed()
                held, rows, entries = [], 0, 0
    if rows:
        yield closed()
