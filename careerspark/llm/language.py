"""Language of a text by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three letters, a blank at either end of a word) of all
learning texts of a language, most frequent first. A text's own list is held against each profile: every n-gram adds
the difference of its two ranks, or the length of a profile if it is not listed there. The language with the smallest
sum wins.

Results of odd rows: a null text or one without a letter is ``und`` with score 0, as is every text when nothing was
learnt; rows with a null language teach nothing; ties go to the language first in order; repeated rows are judged
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_bytes

PROFILE = 300       # n-grams of a profile and of a text's list
CHUNK = 500_000     # bytes of text whose n-grams are held at once
BLANK = 1
ALPHABET: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not ALPHABET:
        ALPHABET.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return ALPHABET[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and code of each n-gram occurrence, and the n-gram of each code (21 bits a letter, in code order)."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low), dtype=np.int64), [len(t) + 1 for t in low])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                 # a blank after each word
    points, text, letter = points[keep], text[keep], letter[keep]
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[points[letter]] = True
    symbols = np.concatenate([[0, BLANK], np.flatnonzero(seen)])
    place = np.zeros(0x110000, np.int64)
    place[symbols[2:]] = np.arange(2, len(symbols))
    code = np.where(letter, place[points], 1)
    n = len(symbols)
    start = np.ones(len(code), bool)        # first letter of a word
    start[1:] = ~letter[:-1]
    before = np.ones_like(code)             # what stands before a letter: a letter or the blank
    before[1:] = code[:-1]
    before[start] = 1
    two = before * n + code
    third = np.zeros_like(code)
    third[1:] = before[:-1]
    inner = ~start
    grams = np.concatenate([code[letter], two, third[inner] * n * n + two[inner]])
    owners = np.concatenate([text[letter], text, text[inner]])
    return owners, grams, symbols


def _spelled(codes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    n = len(symbols)
    return (symbols[codes // (n * n)] << 42) | (symbols[codes // n % n] << 21) | symbols[codes % n]


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an array and their counts."""
    a = np.sort(a)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[first], np.diff(np.append(first, len(a)))


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    column = column.fill_null("")
    _, offsets = text_bytes(column)
    for i, j in slices(offsets, CHUNK):
        yield i, j, column.slice(i, j - i).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language of a partition's texts: text, lang."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, j, texts in _chunks(batch.column(0)):
            names = sorted(set(langs[i:j]))
            which = np.array([names.index(x) for x in langs[i:j]])
            owners, grams, symbols = _grams(texts)
            if not len(grams):
                continue
            size = len(symbols) ** 3
            values, counts = _runs(which[owners] * size + grams)
            for k, name in enumerate(names):
                a, b = np.searchsorted(values, [k * size, (k + 1) * size])
                held = sums.setdefault(name, [])
                held.append((_spelled(values[a:b] - k * size, symbols), counts[a:b]))
                if len(held) >= 32:
                    sums[name] = [_merged(held)]
    for name, held in sums.items():
        grams, counts = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                                         names=["lang", "gram", "n"])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    sums = np.zeros(len(grams), np.int64)
    np.add.at(sums, where, np.concatenate([c for _, c in held]))
    return grams, sums


def profiles(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, place: the ``PROFILE`` most frequent n-grams of each language, places from 0; ties by n-gram."""
    counts = (texts.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
              .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("place", place).filter(F.col("place") < PROFILE).select("lang", "gram", "place")


def _judge(langs: list[str], grams: np.ndarray, places: np.ndarray):
    """``places``: n-gram x language, ``PROFILE`` where a profile lacks it; its last row is all that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in _chunks(batch.column(batch.num_columns - 1)):
                owners, codes, symbols = _grams(texts)
                names, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                if len(codes) and langs:
                    size = len(symbols) ** 3
                    values, counts = _runs(owners * size + codes)
                    doc, code = values // size, values % size
                    most = int(counts.max())
                    order = np.argsort(doc * (most + 1) + (most - counts), kind="stable")
                    doc, code = doc[order], code[order]
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
                    top = place < PROFILE
                    doc, code, place = doc[top], code[top], place[top]
                    key = _spelled(code, symbols)
                    at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
                    at[grams[at] != key] = len(grams)
                    apart = np.where(places[at] < PROFILE, np.abs(places[at] - place[:, None]), PROFILE)
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    away = np.add.reduceat(apart, first, axis=0)
                    best = away.argmin(axis=1)
                    listed = np.diff(np.append(first, len(doc)))
                    names[doc[first]] = np.array(langs, dtype=object)[best]
                    score[doc[first]] = 1 - away[np.arange(len(first)), best] / (PROFILE * listed)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)],
                     pa.array(names.tolist(), pa.string()), pa.array(score)],
                    names=[*batch.schema.names[:-1], "lang_pred", "score"])
    return run


def identify(docs: DataFrame, learn: Column, keep: list[str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Predicts the language of every row's text from profiles of the rows where ``learn`` holds.

    Returns the columns ``keep`` (doc_id if not given), lang_pred and score (0 to 1, 1 for ranks that all agree). Only
    the profiles, ``PROFILE`` rows per language, pass through the driver.
    """
    learnt = profiles(docs.filter(learn), text, lang).toPandas()
    langs = sorted(learnt["lang"].unique())
    grams = np.unique(learnt["gram"].to_numpy(np.int64))
    places = np.full((len(grams) + 1, max(len(langs), 1)), PROFILE, np.int64)
    if len(learnt):
        places[np.searchsorted(grams, learnt["gram"].to_numpy(np.int64)), np.searchsorted(langs, learnt["lang"])] = learnt["place"]
    fields = docs.select(*(keep or ["doc_id"]), F.col(text).alias("_text"))
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(fields.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return fields.mapInArrow(_judge(langs, grams, places), schema)
