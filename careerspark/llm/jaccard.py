"""Similarity join of texts on word shingles: overlap counts from a blocked sparse matrix product.

Two texts link when their shingle sets overlap by ``threshold`` of the union or more. Rows of the incidence matrix are
texts, columns shingles.

1. How many texts hold each shingle is counted over the corpus (``counting``). A shingle of one text alone can add to
   no overlap, so its column is dropped; the size of each set is kept.
2. Copies with the same set are one row of the matrix (a class). Shingles have one global order, rare ones first. Two
   linked sets share one of the first ``n - ceil(threshold n) + 1`` shingles of either, so classes are candidates only
   when these prefixes meet, directly or over others: clusters.
3. A cluster is cut into blocks of bounded size. A task multiplies the rows of one or two blocks, adding up overlap
   counts column by column, drops pairs below the bound that both sizes give, and keeps a spanning forest of the rest,
   so links cost rows in proportion to the texts however large a group of near copies is.
4. Clusters of several blocks take two passes. First each block meets itself and the first block of its own and the next size
   class, which connects what is one large group of near copies. Then candidates are told by each prefix shingle on its own:
   only the sets that hold a shingle whose holders are not all connected yet meet, in blocks if these are many. Pairs
   within a component need no further product, so nothing is lost, and a chain of sets that meet only over others
   costs in proportion to its length. What grows with a square is a shingle that stands in the prefixes of very many
   unlinked sets, in bounded tasks.

Results of odd rows: texts without words (null texts too) have an empty set and link with nothing; fewer words than a
shingle make one shingle of the whole; repeated rows link like other copies; a null id stays null unless the text links
with one that has an id. A text of any length is one row of the matrix; a very long one is hashed by itself, at some 60 bytes of memory
a byte. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, saved
from .components import components
from .counting import answered, counted, decoded, encoded, sums_of

BLOCK_ROWS = 1024
BLOCK_KEYS = 2_000_000
SPAN = 0.98         # width of a size class, in steps of the threshold's ratio: linked sets are in the same or next one
DENSE_FROM = 24     # columns of so many rows are multiplied as dense ones
COLUMNS = 2048      # dense columns multiplied at once


def _sets(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts of a batch, ordered by text, then value; where each text starts; sizes; set hashes."""
    words, lengths = decoded(row)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))         # words from here to the end of the text
    at = np.flatnonzero((left >= width) | (np.arange(len(words)) == np.repeat(starts, lengths)))
    span = np.minimum(left[at], width)
    keys = mixed(span.astype(np.uint64))
    for j in range(width):
        more = span > j
        keys[more] = mixed(keys[more] * np.uint64(0xD1342543DE82EF95) + words[at[more] + j])
    of = text[at]
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[first], of[first]
    sizes = np.bincount(of, minlength=len(lengths))
    starts = np.cumsum(sizes) - sizes
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return keys, starts, sizes, mixed(total[starts + sizes] - total[starts] + sizes.astype(np.uint64))


def _once(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first text of each distinct set of a batch."""
    _, first = np.unique(hashes, return_index=True)
    return np.sort(first[sizes[first] > 0])


def _rows_of(starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = sizes[rows]
    return np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(rows) else np.zeros(0, np.int64)


def _keys_of(width: int):
    def run(row: dict):
        keys, starts, sizes, hashes = _sets(row, width)
        return [(lambda k, n: (k, [n]))(*np.unique(keys[_rows_of(starts, sizes, _once(sizes, hashes))], return_counts=True))]
    return run


SETS = "doc_id long, set_hash long, n_shingles long, prefix array<long>, shared array<long>"


def _describe(width: int, threshold: Fraction):
    """Size and set hash of each text; for the first text of each set, the prefix and the shingles held by others too."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                keys, starts, sizes, hashes = _sets(row, width)
                once = _once(sizes, hashes)
                prefix, shared = [None] * len(sizes), [None] * len(sizes)
                if len(once):
                    own = keys[_rows_of(starts, sizes, once)]
                    held = sums_of(row, 0)[0][np.unique(own, return_inverse=True)[1]]
                    ends = np.cumsum(sizes[once])
                    for t, i, j in zip(once, ends - sizes[once], ends):
                        n, common = j - i, held[i:j] > 1
                        length = n - -(-threshold.numerator * n // threshold.denominator) + 1 - (n - int(common.sum()))
                        if length > 0:
                            common_keys, counts = own[i:j][common], held[i:j][common]
                            prefix[t] = common_keys[np.lexsort((common_keys, counts))][:length].view(np.int64)
                            shared[t] = common_keys.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(hashes.view(np.int64)), pa.array(sizes.astype(np.int64)),
                    pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.int64()))],
                    names=["doc_id", "set_hash", "n_shingles", "prefix", "shared"])
    return run


# ---- the product -----------------------------------------------------------


def overlaps(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Overlap counts of all rows of a block: incidence matrix times its transpose, column block by column block."""
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    held = np.diff(np.append(begin, len(keys)))
    out = np.zeros((rows, rows), np.float64)
    for d in np.unique(held[(held > 1) & (held < DENSE_FROM)]):
        at = begin[held == d]
        i, j = np.triu_indices(d, 1)
        step = max(1, 2_000_000 // len(i))
        for c in range(0, len(at), step):
            members = np.sort(row[at[c:c + step, None] + np.arange(d)], axis=1)
            out += np.bincount((members[:, i] * rows + members[:, j]).ravel(), minlength=rows * rows).reshape(rows, rows)
    wide = np.flatnonzero(held >= DENSE_FROM)
    for c in range(0, len(wide), COLUMNS):
        some = wide[c:c + COLUMNS]
        block = np.zeros((rows, len(some)), np.float32)
        at = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(held[some])[:-1]]), held[some]) + np.arange(held[some].sum())
        block[row[at], np.repeat(np.arange(len(some)), held[some])] = 1
        out += np.triu(block @ block.T, 1)
    return out


def links(sets: list[np.ndarray], sizes: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets whose overlap reaches the bound of their sizes."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    counts = overlaps(np.concatenate(sets), row, len(sets))
    # a / (n + m - a) >= p / q is (p + q) a >= p (n + m)
    bound = threshold.numerator * (sizes[:, None] + sizes[None, :])
    return np.nonzero((counts > 0) & ((threshold.numerator + threshold.denominator) * counts >= bound))


def forest(i: np.ndarray, j: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Edges that keep the same components."""
    root = list(range(rows))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _product(threshold: Fraction):
    """Links within each task of a group of tasks."""
    def run(rows: pa.Table) -> pa.Table:
        task = rows.column("task").to_numpy()
        hashes, sizes = rows.column("set_hash").to_numpy(), rows.column("n_shingles").to_numpy()
        shared = rows.column("shared").combine_chunks()
        order = np.argsort(task, kind="stable")
        a, b = [], []
        for members in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            members = members[np.unique(hashes[members], return_index=True)[1]]
            sets = [shared[int(m)].values.to_numpy() for m in members]
            i, j = links(sets, sizes[members], threshold)
            for x, y in forest(i, j, len(members)):
                a.append(hashes[members[x]])
                b.append(hashes[members[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _multiply(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """``rows`` has task, bin, set_hash, n_shingles, shared; tasks of one bin run in the same call."""
    return rows.groupBy("bin").applyInArrow(_product(threshold), "a long, b long")


def _size_class(n: str, threshold: Fraction) -> Column:
    """Sets that link are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / (F.lit(float(np.log(float(1 / threshold))) / SPAN))).cast("int")


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds ``block`` within (cluster, class) and ``blocks``, their number: each of bounded rows and keys, about."""
    per = rows.groupBy("cluster", "class").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK_ROWS, F.sum(F.size("shared")) / BLOCK_KEYS)).cast("int").alias("blocks"))
    return rows.join(per, ["cluster", "class"]).withColumn("block", F.pmod(F.xxhash64("set_hash"), F.col("blocks")).cast("int"))


def _task(*columns: Column) -> Column:
    return F.xxhash64("cluster", *columns)


def class_links(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that are connected.

    ``classes`` has set_hash, n_shingles, prefix and shared, one row per distinct set.
    """
    prefixes = classes.select("set_hash", F.explode("prefix").alias("key"))
    least = (prefixes.groupBy(F.col("key").alias("_key")).agg(F.min("set_hash").alias("least"), F.max("set_hash").alias("_most"))
             .filter("least <> _most"))
    meet = prefixes.join(least, F.col("key") == F.col("_key")).select(F.col("set_hash").alias("a"), F.col("least").alias("b"))
    cluster = components(meet).select(F.col("node").alias("_node"), F.col("root").alias("cluster"))
    rows = saved(classes.join(cluster, F.col("set_hash") == F.col("_node")).select(
        "cluster", "set_hash", "n_shingles", "shared", _size_class("n_shingles", threshold).alias("class")), "clusters")
    load = rows.groupBy("cluster").agg(F.count("*").alias("_rows"), F.sum(F.size("shared")).alias("_keys"))
    load = saved(load.withColumn("large", (F.col("_rows") > BLOCK_ROWS) | (F.col("_keys") > BLOCK_KEYS)), "cluster-loads")
    totals = load.filter("not large").agg(F.sum("_rows"), F.sum("_keys")).first()
    bins = 1 + int(max((totals[0] or 0) / BLOCK_ROWS, (totals[1] or 0) / BLOCK_KEYS))
    small = rows.join(load.filter("not large").select("cluster"), "cluster", "left_semi").select(
        F.col("cluster").alias("task"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"), "set_hash", "n_shingles", "shared")
    found = _multiply(small, threshold)
    if load.filter("large").isEmpty():
        return found

    large = saved(_blocks(rows.join(load.filter("large").select("cluster"), "cluster", "left_semi")), "large-clusters")
    shape = large.select("cluster", "class", "blocks").distinct()
    after = shape.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("blocks_after"))
    before = shape.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("blocks_before"))
    placed = large.join(after, ["cluster", "class"], "left").join(before, ["cluster", "class"], "left")

    def runs(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    def name(lower: Column | int, upper: Column | int, shift: int) -> Column:
        return _task(F.col("class") + shift, F.lit(lower) if isinstance(lower, int) else lower,
                     F.lit(upper) if isinstance(upper, int) else upper)

    block, nothing = F.col("block"), F.array().cast("array<bigint>")
    first = block == 0
    tasks = F.array_distinct(F.flatten(F.array(
        # within the class: own block, and the first block with each
        F.array(name(block, -1, 0), name(0, F.when(first, F.lit(-1)).otherwise(block), 0)),
        F.when(first, F.transform(runs("blocks"), lambda b: name(0, F.when(b == 0, F.lit(-1)).otherwise(b), 0))).otherwise(nothing),
        # with the next class, numbered from 1,000,000 on: first block of either with every block of the other
        F.when(F.col("blocks_after").isNull(), nothing).otherwise(F.when(first, F.concat(
            F.transform(runs("blocks_after"), lambda b: name(0, b + 1_000_000, 0)))).otherwise(F.array(name(block, 1_000_000, 0)))),
        F.when(F.col("blocks_before").isNull(), nothing).otherwise(F.when(first, F.concat(
            F.transform(runs("blocks_before"), lambda b: name(b, 1_000_000, -1)))).otherwise(
            F.array(name(0, block + 1_000_000, -1)))))))
    first_pass = placed.withColumn("task", F.explode(tasks)).select("task", F.col("task").alias("bin"), "set_hash", "n_shingles", "shared")
    found = saved(found.union(_multiply(first_pass, threshold)), "links")

    roots = components(found).select(F.col("node").alias("_node"), "root")
    rooted = large.join(roots, F.col("set_hash") == F.col("_node"), "left").select(
        "set_hash", "n_shingles", "shared", F.coalesce("root", "set_hash").alias("root"))
    return found.union(_by_key(rooted, prefixes, threshold))


def _by_key(rooted: DataFrame, prefixes: DataFrame, threshold: Fraction) -> DataFrame:
    """Links between sets that share a prefix shingle but are not connected yet. ``rooted`` has set_hash, n_shingles, shared and
    root."""
    holders = saved(prefixes.join(rooted.select(F.col("set_hash").alias("_set"), "root", F.size("shared").alias("_size")),
                                  F.col("set_hash") == F.col("_set")).select("key", "set_hash", "root", "_size"), "holders")
    load = (holders.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.ceil(F.greatest(
        F.count("*") / BLOCK_ROWS, F.sum("_size") / BLOCK_KEYS)).cast("int").alias("blocks")).filter("_a <> _b")
        .select(F.col("key").alias("_key"), "blocks"))
    own = F.pmod(F.xxhash64("set_hash"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A block meets itself and every other one once: the task of two blocks is named by the key and both.
    tasks = F.transform(others, lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o)))
    met = saved(holders.join(load, F.col("key") == F.col("_key")).select("set_hash", "_size", F.explode(tasks).alias("task")).distinct(), "holders-met")
    total = met.agg(F.count("*"), F.sum("_size")).first()
    bins = 1 + int(max((total[0] or 0) / BLOCK_ROWS, (total[1] or 0) / BLOCK_KEYS))
    sets = rooted.select(F.col("set_hash").alias("_set"), "n_shingles", "shared")
    rows = met.join(sets, F.col("set_hash") == F.col("_set")).select(
        "task", F.pmod("task", F.lit(bins)).alias("bin"), "set_hash", "n_shingles", "shared")
    return _multiply(rows, threshold)


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """``docs`` has doc_id and text. Returns, for each row, doc_id, n_shingles and component_id, the smallest doc_id of
    all texts reachable by links."""
    share = Fraction(threshold).limit_denominator(10_000)
    texts = docs.select("doc_id", "text", F.lit(0).alias("flag"), F.lit(0).alias("side"))
    batches = encoded(texts, "jaccard-batches")
    sums = counted(batches, _keys_of(width), "jaccard-counts", keys_per_word=0.9)
    sets = saved(answered(batches, sums).mapInArrow(_describe(width, share), SETS), "jaccard-sets")
    classes = (sets.filter(F.size("prefix") > 0).groupBy("set_hash")
               .agg(F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("shared").alias("shared")))
    roots = components(class_links(classes, share)).select(F.col("node").alias("_node"), "root")
    rows = sets.select("doc_id", "n_shingles", "set_hash").join(roots, F.col("set_hash") == F.col("_node"), "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_hash")).alias("_group"))
    least = rows.filter("_group is not null").groupBy(F.col("_group").alias("_of")).agg(F.min("doc_id").alias("_least"))
    return rows.join(least, F.col("_group") == F.col("_of"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))
