"""Language-model scores by deleted interpolation.

P(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1), with weights a that depend on how often the context v was
seen (a bucket per power of two). The learning texts are divided: counts of the first part give the estimates, and
expectation-maximisation on the words of the second (``tune``) gives the weights. The final estimates count both parts.

Corpus counts come from ``counting``; the driver sees the totals N and V and, for the weights, a histogram of the
tuning words over buckets and logarithmic steps of both estimates, whose size does not depend on the corpus.

Results of odd rows: a null text is empty and holds its end alone; a null id is neither learnt from nor held out;
repeated rows count and are scored one by one; with nothing to learn from every word is unknown and V is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed
from .counting import answered, counted, decoded, encoded, sums_of

END, BEGIN = np.uint64(0x5EED0E2D00000001), np.uint64(0x5EED0B6100000001)
WORDS, PAIRS = 0, 1                     # kinds of keys
HELD_OUT, ESTIMATE, TUNE = 0, 1, 2      # flags of texts
BUCKETS = 42
STEP = 0.25                             # of log2, in the histogram of the tuning words
ROUNDS = 60


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int


@dataclass(frozen=True)
class Model:
    learnt: Totals
    weights: np.ndarray     # bucket x (a0, a1, a2)


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each text, the context of each, and the text that each belongs to."""
    words, lengths = decoded(row)
    ends = np.cumsum(lengths)
    tokens = np.insert(words, ends, END)
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[ends - lengths + np.arange(len(lengths))] = BEGIN
    return tokens, context, text


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(context * np.uint64(0xD6E8FEB86659FD93) + (token ^ (token >> np.uint64(32))))


def _keys(row: dict) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    tokens, context, text = _sequence(row)
    flag = np.asarray(row["flags"], np.int64)[text]
    out = []
    for keys in (tokens, _pair(context, tokens)):
        distinct, where = np.unique(keys, return_inverse=True)
        out.append((distinct, [np.bincount(where[flag == ESTIMATE], minlength=len(distinct)),
                               np.bincount(where[flag != HELD_OUT], minlength=len(distinct))]))
    return out


def _counts(row: dict, counter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, c(context), c(token) and c(context, token) of each token of a batch."""
    tokens, context, text = _sequence(row)
    words, at = np.unique(tokens, return_inverse=True)
    of_word = sums_of(row, WORDS)[counter]
    c_token = of_word[at]
    c_context = of_word[np.minimum(np.searchsorted(words, context), len(words) - 1)]
    c_context[context == BEGIN] = of_word[np.searchsorted(words, END)]
    c_pair = sums_of(row, PAIRS)[counter][np.unique(_pair(context, tokens), return_inverse=True)[1]]
    return text, c_context, c_token, c_pair


def _bucket(c_context: np.ndarray) -> np.ndarray:
    return np.where(c_context > 0, np.minimum(np.log2(np.maximum(c_context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _histogram(totals: Totals):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, c_context, c_token, c_pair = _counts(row, 0)
                pair, token = c_pair / np.maximum(c_context, 1), c_token / max(totals.tokens, 1)
                steps = [np.where(p > 0, (-np.log2(np.maximum(p, 1e-300)) / STEP).astype(np.int64), -1) for p in (pair, token)]
                cell = (_bucket(c_context) << 40) + ((steps[0] + 1) << 20) + steps[1] + 1
                cells, at, n = np.unique(cell, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(n.astype(np.int64)), pa.array(np.bincount(at, pair)), pa.array(np.bincount(at, token))],
                    names=["cell", "n", "pair", "token"])
    return run


def learnt_weights(bucket: np.ndarray, n: np.ndarray, pair: np.ndarray, token: np.ndarray, types: int) -> np.ndarray:
    """Expectation-maximisation for each bucket: n tuning words with estimates ``pair`` and ``token`` each.

    A bucket without tuning words takes the weights of all words of its kind of context, known or unknown.
    """
    flat = 1.0 / (types + 1)
    parts = np.stack([np.full(len(n), flat), token, pair], axis=1)

    def fit(rows: np.ndarray) -> np.ndarray:
        a = np.array([0.1, 0.4, 0.5])
        for _ in range(ROUNDS):
            share = parts[rows] * a
            share /= share.sum(axis=1, keepdims=True)
            a = (share * n[rows, None]).sum(axis=0) / n[rows].sum()
            a = np.maximum(a, [1e-6, 0, 0])         # an unknown word keeps some probability
            a /= a.sum()
        return a

    known = np.flatnonzero(bucket > 0)
    general = fit(known) if len(known) else np.array([0.1, 0.4, 0.5])
    weights = np.tile(general, (BUCKETS, 1))
    unseen = general[:2] / max(general[:2].sum(), 1e-9)
    weights[0] = [*unseen, 0.0] if unseen.sum() else [1.0, 0.0, 0.0]
    for b in np.unique(bucket):
        weights[b] = fit(np.flatnonzero(bucket == b))
    weights[0, 2] = 0.0                             # no estimate without the context
    weights[0] /= weights[0].sum()
    return weights


def _scores(model: Model):
    flat, tokens = 1.0 / (model.learnt.types + 1), model.learnt.tokens

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                text, c_context, c_token, c_pair = _counts(row, 1)
                a = model.weights[_bucket(c_context)]
                p = a[:, 2] * c_pair / np.maximum(c_context, 1) + a[:, 1] * c_token / max(tokens, 1) + a[:, 0] * flat
                base = np.log10((c_token + 1) / (tokens + model.learnt.types + 1))
                n = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(np.asarray(row["flags"]) == HELD_OUT),
                    pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(text[c_token > 0], minlength=n).astype(np.int64)),
                    pa.array(np.full(n, tokens, np.int64)), pa.array(np.bincount(text, base, n)),
                    pa.array(np.bincount(text, np.log10(p), n))],
                    names=["doc_id", "not_learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, learn: Column, tune_one_in: int = 8) -> DataFrame:
    """Scores every text with a model learnt from the rows where ``learn`` holds.

    ``docs`` has doc_id and text. Returns doc_id, not_learnt, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score, both as the log10 probability of the text. One text in ``tune_one_in`` of those learnt from,
    by a hash of its id, sets the weights.
    """
    tune = F.pmod(F.xxhash64("doc_id"), F.lit(tune_one_in)) == 0
    flag = F.when(~F.coalesce(learn, F.lit(False)), HELD_OUT).when(tune, TUNE).otherwise(ESTIMATE)
    texts = docs.select("doc_id", "text", flag.alias("flag")).withColumn("side", (F.col("flag") == TUNE).cast("int"))
    batches = encoded(texts, "lm-batches")
    sums = counted(batches, _keys, "lm-counts", keys_per_word=1.1)
    stats = (sums.filter((F.col("kind") == WORDS) & F.col("stats").isNotNull())
             .agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(4)]).first())
    estimates, learnt = Totals(stats["s1"], stats["s0"]), Totals(stats["s3"], stats["s2"])

    tuning = answered(batches.filter(F.col("side") == 1), sums)
    cells = (tuning.mapInArrow(_histogram(estimates), "cell long, n long, pair double, token double")
             .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pair").alias("pair"), F.sum("token").alias("token"))
             .orderBy("cell").toPandas())
    n = cells["n"].to_numpy(float)
    weights = learnt_weights(cells["cell"].to_numpy(np.int64) >> 40, n, cells["pair"].to_numpy() / np.maximum(n, 1),
                             cells["token"].to_numpy() / np.maximum(n, 1), estimates.types)
    return answered(batches, sums).mapInArrow(
        _scores(Model(learnt, weights)),
        "doc_id long, not_learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
