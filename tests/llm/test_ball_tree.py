"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from careerspark.llm import ball_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, t in items:
        texts[i] = min(texts.get(i, t or ""), t or "")
    out = set()
    for item, text in texts.items():
        scored = []
        for i, bag in bags:
            n = sum(bag.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
                        for t in set(terms(text)) if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(4)
    pool = [f"w{k}" for k in range(60)] + ["The", "the", "été", "ÉTÉ", "x_y", "a-b", "日本"]
    docs = [(k, " ".join(rnd.choice(pool[:60 if k % 3 else 20]) for _ in range(rnd.randint(1, 40)))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(5, docs[9][1]), (None, docs[7][1]), (None, None), (2000, None), (2001, " \n"), (2002, "-- !"), (2003, "w1 " * 50_000)]
    items = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 15)))) for k in range(25)]
    items += [(100, docs[7][1]), (100, "w1"), (101, None), (102, "nowhere"), (103, "?!"), (None, "w3 w4"), (104, "ÉTÉ the")]
    return docs, items


@pytest.mark.parametrize("tree_rows, leaf_rows, block, read", [(4096, 64, 100_000, 1 << 20), (20, 3, 40, 64)])
def test_against_a_plain_ranking(spark, tables, monkeypatch, tree_rows, leaf_rows, block, read):
    for name, value in (("TREE_ROWS", tree_rows), ("LEAF_ROWS", leaf_rows), ("BLOCK_TERMS", block), ("READ", read)):
        monkeypatch.setattr(ball_tree, name, value)
    docs, items = tables
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id int, text string, doc_id int")
    got = ball_tree.ranked(d, i).collect()
    assert {tuple(r) for r in got} == plain(docs, items) and len(got) == len({(r.item_id, r.rank) for r in got})


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, f"{name} long, text string") for t, name in zip(tables, ("doc_id", "item_id")))
    assert ball_tree.ranked(docs.filter("false"), items).count() == 0
    assert ball_tree.ranked(docs, items.filter("false")).count() == 0


def test_slices_of_terms(monkeypatch):
    text = " ".join(["ab", "c" * 50, "-", "déf"] * 40).encode()
    whole = Counter(t for part in ball_tree.slices_of_terms(text) for t in part)
    monkeypatch.setattr(ball_tree, "READ", 16)
    assert Counter(t for part in ball_tree.slices_of_terms(text) for t in part) == whole


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    topic = np.repeat(np.arange(8), 100)
    dense = np.where(np.arange(80) // 10 == topic[:, None], rnd.integers(1, 10**9, (800, 80)), 0)
    row, columns = np.nonzero(dense)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=800))])
    tree = ball_tree.Tree(starts, columns, dense[row, columns], 80, 10)
    for t in range(8):
        terms = np.arange(10 * t, 10 * t + 10)
        scores, bounds = dense[:, terms].sum(axis=1), tree.bounds(terms)
        for (a, b), bound in zip(tree.spans, bounds):
            assert bound >= scores[tree.order[a:b]].max()
        best = []
        read = tree.search(terms, list(range(800)), best, 10)
        assert sorted(s for s, _ in best) == sorted(scores)[-10:] and read < (len(tree.spans) + 1) // 2
