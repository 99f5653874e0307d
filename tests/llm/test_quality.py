"""The quality classifier on corpora with habits of their own."""

import random

import numpy as np
import pytest

from careerspark.llm import quality

POOL = [a + b for a in ("wa", "ni", "lo", "ste", "ri", "tre") for b in ("ter", "ght", "ne", "ver", "wly", "nd", "ll")]


def prose(rnd, n):
    return ". ".join(" ".join(rnd.sample(POOL, 8)).capitalize() for _ in range(n)) + "."


def junk(rnd, kind):
    return (" ".join("#%|" + rnd.choice(POOL) + "@@" for _ in range(60)), "\n".join([prose(rnd, 4)] * 9), " ".join(["win"] * 90))[kind % 3]


HABITS = {
    "none": lambda rnd, text: text,
    "said twice": lambda rnd, text: f"{text}\n{text}",
    "a third said twice": lambda rnd, text: f"{text}\n{text}" if rnd.random() < 0.33 else text,
    "no stops": lambda rnd, text: text.replace(".", ""),
    "capitals": lambda rnd, text: text.upper(),
    "a passage that all share": lambda rnd, text: f"{text} {' '.join(POOL)}.",
}


@pytest.mark.parametrize("habit", HABITS)
def test_habits_of_a_corpus_are_no_faults(spark, habit):
    rnd = random.Random(7)
    rows = [(k, HABITS[habit](rnd, junk(rnd, k // 10) if k % 10 == 0 else prose(rnd, rnd.randint(6, 30)))) for k in range(600)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    good = [r.quality for r in out if r.doc_id % 10]
    bad = [r.quality for r in out if r.doc_id % 10 == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_short_texts_stay(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.sample(POOL, rnd.randint(1, 9))) + rnd.choice(["", "."])) for k in range(300)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("quality = 1").count() >= 294


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_no_corpus_is_lost_as_a_whole(spark, kind):
    rnd = random.Random(9)
    rows = [(k, junk(rnd, kind)) for k in range(200)]
    assert quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).filter("quality = 1").count() >= 180


def test_good_is_never_up_to_one_labeller():
    """With any one labeller that votes bad on most texts, the texts that all others call good are good."""
    for k in range(len(quality.LABELLERS)):
        all_good = sum(3 ** j for j in range(len(quality.LABELLERS)))
        patterns = np.array([all_good + 3 ** k, all_good, 2 * all_good])
        posterior = quality.fitted_labellers(patterns, np.array([700.0, 200.0, 100.0]))
        assert posterior[patterns[0]] > 0.5 and posterior[patterns[1]] > 0.5 and posterior[patterns[2]] < 0.5


def test_sample_and_odd_rows(spark):
    rnd = random.Random(10)
    rows = [(7, "the same text. " * 3)] * 300 + [(k, prose(rnd, 8)) for k in range(100)] + [(None, prose(rnd, 8)), (None, None), (500, "")] + [(501, prose(rnd, 9_000))]
    docs = spark.createDataFrame([(*r, "a", 0.5) for r in rows], "doc_id long, text string, _text string, score double")
    few = quality._sample(docs.filter("length(text) > 0").selectExpr("xxhash64(doc_id, text) as _h", "text as _text"), 20, 402).collect()
    assert len(few) == 20 and len({r[0] for r in few}) == 20
    once, again = (sorted(map(str, quality.classify(docs.repartition(n), sample=50).collect())) for n in (2, 5))
    assert once == again
    out = quality.classify(docs).collect()
    assert all(r.quality == 0 and r.score == 0 for r in out if r.doc_id == 500) and len(out) == len(rows)
    with pytest.raises(ValueError, match="score"):
        quality.classify(docs, keep=["doc_id", "score"])
