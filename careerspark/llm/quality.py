"""Text quality from weak labels.

Heuristic labellers measure each text and vote good, bad or nothing on it. What counts as much is judged against the
corpus: where a quarter of all texts reach a labeller's good bound, its bounds move up by the difference, so that a habit of the
corpus (passages said twice, no stops, few words) is no fault. Expectation-maximisation over the counts of all vote
patterns of the corpus then estimates, for a few kinds of text, how often each kind gets each vote of each labeller; all rates
are learnt, from a prior that weighs as much as one text in twenty. Good are the kinds that most labellers call good
and that make up a fair share of the corpus, or else the one that labellers call good most often, so no corpus is bad as a
whole. Posteriors of a bounded sample train a linear scorer on hashed features, so that texts on which
labellers say nothing or err are judged by what the text looks like: its words, its letters, the shapes of its signs
and how much of it, over its whole length, has been said before. Its threshold keeps all but one in 200 of the texts
that labellers call good.

Patterns are at most 3 to the number of labellers. The sample is ``sample`` texts, those with the smallest hash of id and text
(and rows equal to the last of these); it comes to the driver as sparse rows and is held there as one table of ``sample`` x 4,096
single-precision numbers (98 MB), all other statistics cover all texts.

Results of odd rows: a null or empty text has quality 0 and score 0; repeated rows are judged one by one; with no
text at all to learn from every text is kept with the score of the prior. A very long text is read whole; it needs some
60 bytes of memory a byte, in one task. Columns other than the id, the text and those of ``keep`` are not read; ``keep`` must not
name a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import mixed, saved, slices, text_bytes, word_hashes, word_spans

SAMPLE = 6_000
RESULTS = ("quality", "score", "weak_posterior")
#: Hashed features of each family; a text's features are shares, so its length does not matter.
SHAPES, WORDS, LETTERS, LOOPS = 2_048, 1_024, 1_008, 16
BINS = SHAPES + WORDS + LETTERS + LOOPS
LOOP = 8                    # words in a row that count as said before when the text has had them
LABELLERS = ("odd_words", "symbols", "capitals", "repeats", "variety", "prose", "loops")
#: Bounds of (bad, good) of each labeller; between them it says nothing. Large values are bad.
BOUNDS = {"odd_words": (0.30, 0.10), "symbols": (0.09, 0.06), "capitals": (0.40, 0.20), "repeats": (0.20, 0.05),
          "variety": (0.60, 0.45), "prose": (0.97, 0.93), "loops": (0.60, 0.40)}
FEW = 40                    # signs added to a text, so that a few of them prove nothing
#: Labellers that see what is special of each kind of text: nothing, faults of form, of content, things said over and over.
KINDS = ((), ("odd_words", "symbols", "capitals", "prose"), ("repeats", "variety", "prose", "loops"), ("loops",))
HABIT = 0.75                # the quantile of the corpus that a labeller's good bound is held against
PRIOR = 0.05                # texts that the prior of the rates stands for, as a share of all
FAIR = 0.25                 # the share of the corpus from which a kind that most labellers call good is good
LOST = 0.005                # texts called good by labellers that the scorer may call bad
LEVELS = 1_000              # measures are kept in so many steps of 0 to 1
SHORT = 20                  # words; a shorter text has no prose to speak of
SHAPE = np.zeros(256, np.uint64)
for _b in range(256):       # letters of one case, digits and white space are alike; each other sign is itself
    _c = chr(_b)
    SHAPE[_b] = (1 if _b >= 128 or "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9"
                 else 4 if _c in " \t\n\r\x0b\x0c" else 16 + _b)
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] = LOWER[97:123]                # A-Z count as a-z
STOP = np.isin(np.arange(256), np.frombuffer(b".,;:?!", np.uint8))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _looped(words: np.ndarray, text: np.ndarray, size: int = LOOP) -> np.ndarray:
    """For each word, whether the ``size`` words that end with it stand earlier in the same text, however far."""
    looped = np.zeros(len(words), bool)
    if len(words) < size:
        return looped
    n = len(words) - size + 1
    key = mixed(text[:n].astype(np.uint64) + np.uint64(1))
    for j in range(size):
        key = mixed(key * np.uint64(0xD1342543DE82EF95) + words[j:j + n])
    at = np.flatnonzero(text[:n] == text[size - 1:])
    order = at[np.argsort(key[at], kind="stable")]
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    looped[again + size - 1] = True
    return looped


def _measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labeller x text values, and per word: its text, whether it repeats the word before, its hash, whether it ends a loop.

    The values are the shares of: words that do not start with a letter or digit and end so, but for one stop; signs
    other than letters, digits and white space; capitals among letters; words equal to the one before; words said
    before among 64 neighbours (the same for any length of a text); words without a stop (short texts: none); words that
    end a run of words which the whole text has had before.
    """
    shape = SHAPE[data]
    size = np.maximum(np.diff(offsets), 1)
    words, n = word_hashes(data, offsets)
    text = np.repeat(np.arange(len(n)), n)
    bounds = np.concatenate([[0], np.cumsum(n)])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    group = text.astype(np.uint64) << np.uint64(32) | ((np.arange(len(words)) - bounds[text]) // 64).astype(np.uint64)
    key = mixed(group * np.uint64(0x9E3779B97F4A7C15) ^ words)
    order = np.argsort(key)
    said = np.zeros(len(words), bool)
    said[order[1:]] = key[order[1:]] == key[order[:-1]]
    looped = _looped(words, text)
    first, last = word_spans(data, offsets)
    plain = shape <= 3
    stop = STOP[data]
    stopped = stop[last] & plain[np.maximum(last - 1, first)]
    odd = ~(plain[first] & (plain[last] | stopped))
    letters, upper = _sums(shape <= 2, offsets), _sums(shape == 2, offsets)
    count = np.maximum(n, 1)
    return np.stack([
        _sums(odd, bounds) / (count + 3), _sums(shape >= 16, offsets) / (size + FEW), upper / (letters + FEW),
        _sums(same, bounds) / (count + 3), _sums(said, bounds) / (count + 3),
        np.where(n >= SHORT, 1 - _sums(stopped, bounds) / count, 0.95), _sums(looped, bounds) / (count + 3)]), text, same, words, looped


def _steps(measures: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(measures * LEVELS), 0, LEVELS).astype(np.int32)


def corpus_bounds(habits: list[int | None]) -> np.ndarray:
    """(bad, good) of each labeller in steps, moved up by what the habit of the corpus exceeds the good bound."""
    bounds = np.array([[round(x * LEVELS) for x in BOUNDS[name]] for name in LABELLERS])
    over = [0 if h is None else max(0, h - good) for h, (_, good) in zip(habits, bounds.tolist())]
    return bounds + np.array(over)[:, None]


def _votes(steps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Votes of each text as digits of base 3: 0 nothing, 1 good, 2 bad."""
    votes = np.where(steps >= bounds[:, :1], 2, np.where(steps <= bounds[:, 1:], 1, 0))
    return (votes * 3 ** np.arange(len(LABELLERS))[:, None]).sum(axis=0)


def _bins(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, same: np.ndarray, words: np.ndarray,
          looped: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of hashed features, as (text, bin): the shapes of three neighbouring signs, runs of repeated words, words,
    three neighbouring signs themselves, and words that end what was said before."""
    shape = SHAPE[data]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.zeros(len(data), bool)
    inside[2:] = of[2:] == of[:-2] if len(data) > 2 else False
    code = np.zeros(len(data), np.uint64)
    if len(data) > 2:
        code[2:] = (shape[:-2] * np.uint64(512) + shape[1:-1]) * np.uint64(512) + shape[2:]
    table = np.uint64(SHAPES)
    three = mixed(code[inside] + np.uint64(1)) % table
    run = np.zeros(len(same), np.uint64)
    run[1:] = same[:-1].astype(np.uint64)
    pairs = mixed(same.astype(np.uint64) * np.uint64(2) + run + np.uint64(1 << 40)) % table
    signs = LOWER[data]
    code = np.zeros(len(data), np.uint64)
    if len(data) > 2:
        code[2:] = (signs[:-2] * np.uint64(256) + signs[1:-1]) * np.uint64(256) + signs[2:]
    letters = mixed(code[inside] + np.uint64(1 << 42)) % np.uint64(LETTERS)
    return [(of[inside], three.astype(np.int64)), (text, pairs.astype(np.int64)),
            (text, SHAPES + (words % np.uint64(WORDS)).astype(np.int64)),
            (of[inside], SHAPES + WORDS + letters.astype(np.int64)), (text, SHAPES + WORDS + LETTERS + looped.astype(np.int64))]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts there are of each value of each measure, and of each set of measures."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for i, j in slices(offsets):
            part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            steps = _steps(_measures(part, at)[0])[:, np.diff(at) > 0]
            yield pa.RecordBatch.from_arrays([pa.array(row) for row in steps], names=list(LABELLERS))


def _example(posterior: np.ndarray, bounds: np.ndarray):
    """The features of each text as a sparse row, with its posterior."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                measures, *of_words = _measures(part, at)
                families = _bins(part, at, *of_words)
                target = posterior[_votes(_steps(measures), bounds)]
                for d in range(j - i):
                    x = np.zeros(BINS, np.float32)
                    for of, bins in families:
                        a, b = np.searchsorted(of, [d, d + 1])
                        if b > a:
                            x += np.bincount(bins[a:b], minlength=BINS) / (b - a)
                    at_bin = np.flatnonzero(x).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([at_bin.tobytes()]), pa.array([x[at_bin].tobytes()]), pa.array([target[d]])],
                                                     names=["bins", "shares", "good"])
    return run


def fitted_labellers(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of good for every vote pattern. Votes are independent within a kind of text."""
    digits = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    prior = np.empty((len(KINDS), len(LABELLERS), 3))       # kind; labeller; vote nothing, good, bad
    for kind, sees in enumerate(KINDS):
        seldom = 0.02 if kind else 0.005
        prior[kind] = [[0.2, 0.2, 0.6] if x in sees else [0.18, 0.82 - seldom, seldom] for x in LABELLERS]
    chance, share = prior, np.array([0.9, 0.04, 0.04, 0.02])
    held = PRIOR * n.sum()

    def posterior(of: np.ndarray) -> np.ndarray:
        logs = np.log(share)[None] + sum(np.log(chance[:, k, of[:, k]]).T for k in range(len(LABELLERS)))
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(rounds if n.sum() else 0):
        weight = posterior(digits) * n[:, None]
        counts = np.stack([[weight[digits[:, k] == vote].sum(axis=0) for vote in range(3)] for k in range(len(LABELLERS))])
        chance = counts.transpose(2, 0, 1) + held * share[:, None, None] * prior + 0.5 * prior
        chance = chance / chance.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=0) + 1) / (n.sum() + len(KINDS))
    calls_good = (chance[:, :, 1] > chance[:, :, 2]).sum(axis=1)
    good = (2 * calls_good > len(LABELLERS)) & (share >= FAIR)
    if not good.any():
        good = np.arange(len(KINDS)) == (chance[:, :, 1].mean(axis=1)).argmax()
    every = np.arange(3 ** len(LABELLERS))
    return posterior((every[:, None] // 3 ** np.arange(len(LABELLERS))) % 3)[:, good].sum(axis=1)


def fitted_scorer(x: np.ndarray, good: np.ndarray, steps: int = 300, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors; both classes weigh the same. Returns weights and bias, and works in place of ``x``."""
    w, bias = np.zeros(x.shape[1], np.float64), 0.0
    called_good = good >= 0.5
    if not len(x) or called_good.all() or not called_good.any():
        return w, 2.0 if not len(x) or called_good.all() else -2.0
    weight = np.where(called_good, 0.5 / called_good.sum(), 0.5 / (~called_good).sum())
    mean = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean ** 2, 0))
    scale = (1 / (spread + 1e-3)).astype(np.float32)
    x *= scale
    centre = weight @ x / weight.sum()
    x -= centre.astype(np.float32)
    grad_w, grad_b = np.zeros_like(w), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + bias, -30, 30)))
        gap = weight * (p - good)
        grad_w, grad_b = 0.9 * grad_w + x.T @ gap.astype(np.float32) + 1e-3 * w, 0.9 * grad_b + gap.sum()
        w, bias = w - rate / len(LABELLERS) * 0.05 * grad_w, bias - rate * 0.1 * grad_b
    least = np.quantile((x @ w.astype(np.float32))[called_good], LOST)
    bias = max(bias, 1e-6 - least)
    return w * scale, float(bias - (w * centre).sum())


def _examples(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows written into one table, as they come to the driver."""
    x, good = np.zeros((n, BINS), np.float32), np.zeros(n)
    for k, r in enumerate(rows.toLocalIterator()):
        x[k, np.frombuffer(r["bins"], np.uint16)] = np.frombuffer(r["shares"], np.float32)
        good[k] = r["good"]
    return x, good


def _judge(posterior: np.ndarray, bounds: np.ndarray, w: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                measures, *of_words = _measures(part, at)
                z = np.full(j - i, bias)
                for of, bins in _bins(part, at, *of_words):
                    n = np.bincount(of, minlength=j - i)
                    z += np.bincount(of, w[bins], j - i) / np.maximum(n, 1)
                score = np.where(np.diff(at) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)],
                     pa.array((score >= 0.5).astype(np.int32)), pa.array(score),
                     pa.array(np.where(np.diff(at) > 0, posterior[_votes(_steps(measures), bounds)], 0.0))],
                    names=[*batch.schema.names[:-1], "quality", "score", "weak_posterior"])
    return run


def classify(docs: DataFrame, sample: int = SAMPLE, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Judges every row's text: the columns ``keep`` (doc_id if not given), quality (1 good, 0 bad), score (0 to 1) and
    weak_posterior, what the labellers alone say."""
    keep = keep or ["doc_id"]
    clash = [c for c in keep if c in RESULTS]
    if clash:
        raise ValueError(f"keep names result columns: {', '.join(clash)}")
    steps = saved(docs.select(F.col(text).alias("_text")).mapInArrow(_measured, ", ".join(f"{x} int" for x in LABELLERS)), "quality-measures")
    bounds = corpus_bounds(_habits(steps))
    vote = sum((F.when(F.col(x) >= int(bad), 2).when(F.col(x) <= int(good), 1).otherwise(0) * 3 ** k for k, (x, (bad, good)) in enumerate(zip(LABELLERS, bounds))), F.lit(0))
    counts = steps.groupBy(vote.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect()
    posterior = fitted_labellers(np.array([r["pattern"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.float64))
    texts = _sample(docs.filter(F.length(text) > 0).select(F.xxhash64("doc_id", text).alias("_h"), F.col(text).alias("_text")),
                    sample, sum(r["n"] for r in counts))
    rows = saved(texts.mapInArrow(_example(posterior, bounds), "bins binary, shares binary, good double"), "quality-examples")
    w, bias = fitted_scorer(*_examples(rows, rows.count()))
    fields = docs.select(*keep, F.col(text).alias("_text"))
    schema = (StructType(fields.schema.fields[:-1]).add("quality", IntegerType()).add("score", DoubleType())
              .add("weak_posterior", DoubleType()))
    return fields.mapInArrow(_judge(posterior, bounds, w, bias), schema)


def _sample(hashed: DataFrame, sample: int, n: int) -> DataFrame:
    """The texts with the ``sample`` smallest hashes, each once however often it is repeated."""
    share = min(1.0, 4 * sample / max(1, n))
    while True:
        low = hashed.filter(F.col("_h") <= int(share * 2.0 ** 63) * 2 - (1 << 63)) if share < 1 else hashed
        found = low.select("_h").distinct().orderBy("_h").limit(sample).agg(F.count("_h"), F.max("_h")).first()
        if found[0] >= sample or share >= 1:
            return hashed.filter(F.col("_h") <= F.lit(found[1])).dropDuplicates(["_h"]).select("_text")
        share = min(1.0, 16 * share)


def _habits(steps: DataFrame) -> list[int | None]:
    """What a quarter of all texts reach in each measure."""
    long = steps.select(F.posexplode(F.array(*LABELLERS)).alias("k", "step")).groupBy("k", "step").agg(F.count(F.lit(1)).alias("n"))
    found: list[int | None] = [None] * len(LABELLERS)
    by_measure: dict[int, list[tuple[int, int]]] = {}
    for r in long.collect():        # at most LEVELS + 1 rows a labeller
        by_measure.setdefault(r["k"], []).append((r["step"], r["n"]))
    for k, pairs in by_measure.items():
        step, n = np.array(sorted(pairs)).T
        found[k] = int(step[np.searchsorted(np.cumsum(n), HABIT * n.sum())])
    return found
