"""Each operator against a plain version, on small tables with odd rows."""

import datetime
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerspark.llm import bpe, components, jaccard, language, licences, lm_score, packing, quality, rotated, topk, url_lists

DOCS = "doc_id long, text string, lang string, flag string, score int, _text string, batch int"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2) for i, t, lang in rows], DOCS).repartition(3)


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    pool = ["the", "and", "of", "river", "Stone", "light", "é", "x1", "walk", "home", "tree", "sky"]
    rows = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 60))), "en") for k in range(60)]
    base = rows[3][1].split()
    rows += [(100 + k, " ".join(base[:k % len(base)] + ["changed"] + base[k % len(base) + 1:]), "en") for k in range(0, 40, 3)]
    rows += [(200, rows[5][1], "en"), (201, rows[5][1].upper(), None), (202, None, "en"), (203, "", "en"), (204, " \t\n", None),
             (205, "one two", "en"), (205, "one two", "en"), (206, "One  Two", "en"), (None, rows[5][1], "en"), (None, None, None)]
    return rows


def test_scores_match_a_plain_model(spark, rows):
    learn = [(i, t) for i, t, _ in rows if i is not None and i % 3]
    out = lm_score.score_texts(docs_of(spark, rows), learn=F.col("doc_id") % 3 != 0).collect()
    assert len(out) == len(rows)
    counts = Counter(w for _, t in learn for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    plain = Counter()
    for i, t, _ in rows:
        seq = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in seq)
        plain[(i, len(seq), sum(counts[w] > 0 for w in seq), n, round(base, 6), not (i is not None and i % 3))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.not_learnt) for r in out) == plain
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)


def plain_scores(rows, tuned):
    """The interpolated model from dictionaries: weights by bucket of context count, learnt on the texts of ``tuned``."""
    def tokens(t):
        seq = [*words(t), None]
        return list(zip(["", *seq[:-1]], seq))          # the context of a first word is no word

    def counts(texts):
        single, double = Counter(), Counter()
        for t in texts:
            for v, w in tokens(t):
                single[w] += 1
                double[v, w] += 1
        return single, double, sum(single.values())

    def estimates(model, v, w):
        single, double, n = model
        seen = single[None if v == "" else v]
        return (int(math.log2(seen)) + 1 if seen else 0), double[v, w] / max(seen, 1), single[w] / max(n, 1)

    learn = [(i, t) for i, t, _ in rows if i is not None and i % 3]
    first, whole = counts(t for i, t in learn if i not in tuned), counts(t for _, t in learn)
    cells = defaultdict(list)       # by bucket and quarter steps of log2, as the estimates are gathered
    for i, t in learn:
        for v, w in tokens(t) if i in tuned else ():
            b, p2, p1 = estimates(first, v, w)
            cells[b, *(math.floor(-4 * math.log2(p)) if p else None for p in (p2, p1))].append((p2, p1))
    kinds = [(b, len(ps), sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps)) for (b, _, _), ps in cells.items()]

    def fit(part):
        a = [0.1, 0.4, 0.5]
        for _ in range(60):
            new = [0.0] * 3
            for _, n, p2, p1 in part:
                shares = [x * y for x, y in zip(a, (1 / (len(first[0]) + 1), p1, p2))]
                new = [x + n * y / sum(shares) for x, y in zip(new, shares)]
            new = [x / sum(new) for x in new]
            new[0] = max(new[0], 1e-6)
            a = [x / sum(new) for x in new]
        return a

    general = fit([k for k in kinds if k[0]])
    weights = {b: fit([k for k in kinds if k[0] == b]) for b in {k[0] for k in kinds}}
    a0, a1, _ = weights.get(0, general)
    weights[0] = [a0 / (a0 + a1), a1 / (a0 + a1), 0.0]
    for _, t, _ in rows:
        total = 0.0
        for v, w in tokens(t):
            b, p2, p1 = estimates(whole, v, w)
            total += math.log10(sum(x * y for x, y in zip(weights.get(b, general), (1 / (len(whole[0]) + 1), p1, p2))))
        yield total


def test_interpolated_scores_match_a_plain_model(spark, rows):
    long = [(700, "the river " * 30_000 + "new", "en")]
    docs = docs_of(spark, rows + long)
    tuned = {r.doc_id for r in docs.filter("pmod(xxhash64(doc_id), 8) = 0 and doc_id % 3 != 0").collect()}
    assert tuned
    out = lm_score.score_texts(docs, learn=F.col("doc_id") % 3 != 0).collect()
    want = sorted((-1 if i is None else i, s) for (i, _, _), s in zip(rows + long, plain_scores(rows + long, tuned)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in out)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-6)


def test_weights_by_expectation_maximisation():
    bucket = np.array([1, 1, 1, 0])
    w = lm_score.learnt_weights(bucket, np.array([8.0, 1.0, 1.0, 5.0]), np.array([0.5, 0.0, 0.0, 0.0]), np.array([0.01, 0.2, 0.0, 0.1]), 99)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 2] == 0 and w[1, 2] > 0.6 and (w[:, 0] > 0).all()


def test_nothing_to_learn_from(spark, rows):
    out = lm_score.score_texts(docs_of(spark, rows[:5]), learn=F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in out)
    assert lm_score.score_texts(docs_of(spark, rows).filter("false"), learn=F.lit(True)).count() == 0


def plain_components(rows):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(t) for _, t, _ in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return Counter((i, len(s), min(ids[find(k)], default=None) if s else i) for k, ((i, _, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_near_duplicates(spark, rows, monkeypatch, block_rows):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)      # 3: clusters cut into many blocks
    found = jaccard.near_duplicates(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows)


def test_near_duplicates_of_nothing(spark, rows):
    assert jaccard.near_duplicates(docs_of(spark, rows).filter("false")).count() == 0


def test_overlaps_of_narrow_and_wide_columns():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(1, 30))) for _ in range(50)]
    counts = jaccard.overlaps(np.concatenate(sets), np.repeat(np.arange(50), [len(s) for s in sets]), 50)
    for i in range(50):
        for j in range(i + 1, 50):
            assert counts[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 300), (300, 200)] + [(-5, k) for k in range(400, 450)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 1) for k in range(1, 41)} | {(k, 90) for k in (90, 95, 100)} | {(200, 200), (300, 200)} | {(k, -5) for k in (-5, *range(400, 450))}


def test_languages(spark):
    rnd = random.Random(1)
    pools = {"en": "the with that this from which have water night light".split(), "de": "der und nicht schön über straße wird auch haben nacht".split()}
    rows = [(k, " ".join(rnd.choice(pools[("en", "de")[k % 2]]) for _ in range(30)), ("en", "de")[k % 2]) for k in range(60)]
    rows += [(60, None, "en"), (61, "", "de"), (62, "12 345 !!", "en"), (63, "the water", None), (64, "Nicht " * 9000, "de")]
    out = {r.doc_id: r for r in language.identify(docs_of(spark, rows), learn=F.col("doc_id") % 5 != 0).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:60]) and out[63].lang_pred == "en" and out[64].lang_pred == "de"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (60, 61, 62)) and all(0 <= r.score <= 1 for r in out.values())
    none = language.identify(docs_of(spark, rows[:3]), learn=F.lit(False)).collect()
    assert [r.lang_pred for r in none] == ["und"] * 3


def test_ngrams_of_a_text():
    owners, grams, symbols = language._grams(["ab c", "", "B"])
    spelled = Counter((int(o), "".join(chr(int(x)) for x in (g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if x).replace("\x01", "_"))
                      for o, g in zip(owners, language._spelled(grams, symbols)))
    assert spelled == Counter([(0, x) for x in ("a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_")] + [(2, x) for x in ("b", "_b", "b_", "_b_")])


def test_quality(spark):
    rnd = random.Random(3)
    pool = "water night light stone river walked slowly under tall old trees".split()

    def prose(n):
        return ". ".join(" ".join(rnd.sample(pool, 8)).capitalize() for _ in range(n)) + "."

    def bad(k):
        words = prose(6).split()
        return (" ".join(w + "%%%" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:4] for _ in range(30)))[k % 3]

    rows = [(k, bad(k) if k % 6 == 0 else prose(6), "en") for k in range(360)] + [(900, None, "en"), (901, "", "en"), (1, rows_text := prose(3), "en"), (1, rows_text, "en")]
    out = quality.classify(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.quality == (0 if r.doc_id in (900, 901) or r.doc_id % 6 == 0 else 1), r
    assert quality.classify(docs_of(spark, rows).filter("false")).count() == 0


def test_packing(spark):
    rnd = random.Random(7)
    rows = [(k, "w " * rnd.choice([0, 1, 5, 9, 30, 31, 63, 64, 200]), "en") for k in range(300)] + [(None, None, None), (4, "", "en"), (4, "", "en")]
    out = packing.pack(docs_of(spark, rows), sizes=(16, 32, 64)).collect()
    tokens = Counter()
    for r in out:
        tokens[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(words(t)) + 1
    assert tokens == want
    bins = defaultdict(list)
    for r in out:
        bins[r.bin].append(r)
    assert sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.start)
        ends = [r.start + r.n_tokens for r in pieces]
        assert [r.start for r in pieces] == [0, *ends[:-1]] and {r.capacity for r in pieces} == {min(s for s in (16, 32, 64) if s >= ends[-1])}
    assert sum(want.values()) > 0.95 * sum(p[0].capacity for p in bins.values())
    assert packing.pack(docs_of(spark, rows).filter("false")).count() == 0


def test_automaton_is_the_tokenizer(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    known = tokenizers.Tokenizer.from_file(path)
    known.no_truncation()
    known.no_padding()
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(["a", "an", "the", "ing", "th", "!", "?", "é", "日", "😀", "0", " ", "'s"]) for _ in range(40)) for _ in range(300)]
    texts += ["a" * n for n in range(1, 70)] + ["", "x <|endoftext|> y", "ΑΣ ΟΔΟΣ İ", "　\x85", "thttion " * 5000, "q" * 20_000]
    out = bpe.encode_texts(docs_of(spark, [*[(k, t, "en") for k, t in enumerate(texts)], (9999, None, None)]), path).collect()
    for r in out:
        ids = known.encode(texts[r.doc_id] if r.doc_id != 9999 else "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == known.decode(ids, skip_special_tokens=False)


def one_by_one(counts, sizes):
    """Best fit with every piece and bin for itself: rooms left and sizes of the bins."""
    left, bins = dict(counts), []
    for length in sorted(counts, reverse=True):
        smaller = sorted(k for k in counts if k < length)
        while left[length]:
            fits = [b for b in bins if b[0] >= length]
            if not fits:
                size = packing.opening_size(length, left, smaller, sizes)
                fits = [[size, size]]
                bins += fits
            min(fits)[0] -= length
            left[length] -= 1
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_against_single_pieces(seed):
    rnd, sizes = random.Random(seed), (16, 32, 64)
    counts = {k: rnd.choice([1, 2, 3, 7, 40, 300]) for k in rnd.sample(range(1, 65), rnd.randint(1, 20))}
    placed, used = packing.plan(counts, sizes), defaultdict(list)
    for length, n in counts.items():        # every piece once
        rows = placed[placed["length"] == length].sort_values("first")
        assert list(rows["first"]) == [0, *rows["n"].cumsum()[:-1]] and rows["n"].sum() == n
    for length, _, n, first, start, capacity in placed.itertuples(index=False):
        for k in range(n):
            used[first + k].append((start, start + length, capacity))
    for spans in used.values():             # one after the other, in the smallest size that holds them
        spans.sort()
        assert [a for a, _, _ in spans] == [0, *[b for _, b, _ in spans[:-1]]]
        assert {c for _, _, c in spans} == {min(s for s in sizes if s >= spans[-1][1])}
    plain = one_by_one(counts, sizes)
    cost = sum(min(s for s in sizes if s >= size - room) + packing.OVERHEAD for room, size in plain)
    assert sum(spans[0][2] + packing.OVERHEAD for spans in used.values()) <= 1.02 * cost + max(sizes)


@pytest.mark.parametrize("most", [3, 40, 10**6])
def test_transitions(monkeypatch, most):
    """One table entry a sign, whether the table is kept or begun anew in the midst of words."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "MOST_STATES", most)
    path = public.path("word_bpe_49k.json")
    known = tokenizers.Tokenizer.from_file(path)
    known.no_truncation()
    vocabulary, rnd = bpe.read_vocabulary(path), random.Random(2)
    table = bpe.Transitions(vocabulary)
    labels = [t for t in (t.removesuffix(vocabulary["suffix"]) for t in vocabulary["ids"]) if t.isascii() and t.isalpha() and t.islower()]
    words = ["".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(300)] + ["a", "aaaaaaa", "theing" * 50, "".join(labels[:300])]
    for word in words:
        assert table.path(word) == known.encode(word, add_special_tokens=False).ids
        assert len(table.parts) == len(table.rows) == len(table.number) <= most + 1
    filled = [dict(row) for row in table.rows]
    if most == 10**6:
        for word in words:
            table.path(word)
        assert table.rows == filled         # nothing is worked out twice
    with pytest.raises(ValueError):
        table.path("日")                    # signs stand for bytes


def vectors_of(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(rnd.normal(size=(400, 12)) * 0.3)]
    rows += [(400 + k, rows[7][1], "x", 1) for k in range(30)] + [(150, rows[150][1], "x", 1)]
    odd = [(500, None, "x", 1), (501, [], "x", 1), (502, [None] * 12, "x", 1), (503, [float("nan")] * 12, "x", 1), (504, [float("inf")] * 12, "x", 1),
           (None, [0.1] * 12, "x", 1), (505, [0.1, 0.2], "x", 1), (600, [0.3, 0.1], "x", 1)]
    return spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, n string, block int"), rows


def test_exact_top_k(spark):
    df, rows = vectors_of(spark)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    z = {(i, n): np.floor(256 * np.array(v)).astype(int) for n, (i, v, *_) in enumerate(rows)}
    want = []
    for q in range(0, 450, 50):
        scores = sorted((-int(a @ z[q, q] if q < 400 else a @ z[400, 400]), i) for (i, n), a in z.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    want.append((600, 1, 505, int(np.floor(25.6) * np.floor(76.8) + np.floor(51.2) * np.floor(25.6))))
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_rotated_codes(spark):
    df, rows = vectors_of(spark)
    got = defaultdict(list)
    for r in rotated.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 401, 100):
        near = sorted((float(np.sqrt(((np.array(v) - np.array(rows[q][1])) ** 2).sum())), i) for i, v, *_ in rows if i != q)[:10]
        hits += len({i for _, i in near} & {i for _, i, _ in got[q]})
        total += 10
        assert [k for k, *_ in sorted(got[q])] == list(range(1, 11))
    assert hits / total >= 0.9 and [v for _, v, _ in got[600]] == [505]
    assert rotated.search(df.filter("false"), F.lit(True)).count() == 0


def test_url_lists(spark):
    day = datetime.date
    captures = spark.createDataFrame([
        (1, "https://a.b.example.com/x", day(2024, 3, 1), "k"), (2, "HTTP://user@B.example.com.:80/", day(2024, 3, 1), "k"),
        (3, "https://a.b.example.com/x", day(2024, 1, 1), "k"), (4, None, day(2024, 3, 1), "k"), (5, "nothing", None, "k"),
        (6, "https://other.org", day(2024, 3, 1), "k"), (6, "https://other.org", day(2024, 3, 1), "k")], "id int, url string, at date, action string")
    entries = spark.createDataFrame([
        ("example.com", day(2024, 2, 1), "block"), ("b.example.com", day(2024, 2, 15), "allow"), ("b.example.com", day(2024, 3, 2), "block"),
        ("a.b.example.com", day(2024, 3, 5), "block"), (None, day(2024, 1, 1), "block"), ("other.org", None, "block"), ("other.org", day(2024, 1, 1), None)],
        "name string, dated date, action string")
    out = sorted((r.id, r.host or "", r.matched_name or "", r.action) for r in url_lists.judge(captures, entries, "url", "at", ["id"]).collect())
    assert out == [(1, "a.b.example.com", "b.example.com", "allow"), (2, "b.example.com", "b.example.com", "allow"), (3, "a.b.example.com", "", "none"),
                   (4, "", "", "none"), (5, "", "", "none"), (6, "other.org", "", "none"), (6, "other.org", "", "none")]
    assert url_lists.judge(captures.filter("false"), entries, "url", "at", ["id"]).count() == 0


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame([
        (1, "a/LICENSE", mit, "k"), (2, "a/b/c/x.txt", "plain", "k"), (3, "a/b/LICENSE", "head\n" + gpl, "k"), (4, "a/y.txt", None, "k"), (5, "z/y.txt", "", "k"),
        (6, "a/b/own.txt", "text\nreleased under the MIT license", "k"), (7, None, mit, "k"), (8, "x.txt", "a licence to fish for trout in the lake", "k"),
        (2, "a/b/c/x.txt", "plain", "k")], "id int, path string, body string, word string")
    out = sorted((r.id, r.licence, r.origin, r.from_directory) for r in licences.scan(files, "path", "body", F.col("path").endswith("LICENSE"), ["id"]).collect())
    assert out == [(1, "MIT", "header", None), (2, "GPL-3.0", "directory", "a/b"), (2, "GPL-3.0", "directory", "a/b"), (3, "GPL-3.0", "header", None),
                   (4, "MIT", "directory", "a"), (5, None, "none", None), (6, "MIT", "header", None), (7, "MIT", "header", None), (8, None, "none", None)]
    assert licences.scan(files.filter("false"), "path", "body", F.lit(True), ["id"]).count() == 0


def test_licences_of_whole_and_wrapped_texts(spark):
    full = {p.name.removesuffix(".txt"): p.read_text() for p in licences.TEXTS.glob("*.txt")}
    gnu = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU {}General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    wrapped = {"GPL-3.0": "", "LGPL-3.0": "Lesser ", "AGPL-3.0": "Affero "}
    apache = ["Copyright 2020 A. Nyone", "", 'Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.",
              "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0"]
    code = "\n\nint main() {\n  return 0;\n}\n"
    texts = [(name, f"{name}/LICENSE", text.replace("<year>", "2021").replace("<copyright holders>", "Some One Else")) for name, text in full.items()]
    texts += [(name, f"src/{name}.c", "/*\n" + "\n".join(" * " + x.format(word) for x in gnu) + "\n */" + code) for name, word in wrapped.items()]
    texts += [("Apache-2.0", "src/a.py", "\n".join(("# " + x).rstrip() for x in apache) + code),
              *[(name, f"src/{name}.py", "\n".join(("# " + x).rstrip() for x in full[name].split("\n")) + code) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")],
              ("GPL", "t/1", "GNU GENERAL PUBLIC LICENSE"), ("MIT", "t/2", "MIT License"), ("Apache-2.0", "t/3", "Apache License"), ("ISC", "t/4", "ISC License"),
              ("MIT", "t/5", "// SPDX-License-Identifier: MIT" + code), ("LGPL-2.1", "t/6", "# SPDX-License-Identifier: LGPL-2.1-or-later" + code),
              ("MIT OR Apache-2.0", "t/7", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */" + code), ("BSD-2-Clause", "t/8", "x = 1\nReleased under the BSD 2-Clause license."),
              (None, "t/9", "my driver license is lost"), (None, "t/10", "she asked for permission to leave the house" + code)]
    files = spark.createDataFrame([(k, p, t) for k, (_, p, t) in enumerate(texts)], "id int, path string, body string").repartition(3)
    out = {r.id: r for r in licences.scan(files, "path", "body", F.col("path").endswith("LICENSE"), ["id"]).collect()}
    assert len(out) == len(texts)
    assert [(name, p, out[k].licence) for k, (name, p, _) in enumerate(texts) if out[k].licence != name] == []


def test_url_lists_of_many_labels(spark):
    day = datetime.date
    deep = "a.b.c.d.e.f.g.h.i.org"
    captures = spark.createDataFrame([(1, f"https://{deep}/x", day(2024, 3, 1)), (2, f"https://z.y.{deep}/x", day(2024, 3, 1)), (3, "https://h.i.org", day(2024, 3, 1))], "id int, url string, at date")
    entries = spark.createDataFrame([("i.org", day(2024, 1, 1), "allow"), (deep.split(".", 1)[1], day(2024, 2, 1), "block")], "name string, dated date, action string")
    out = sorted((r.id, r.matched_name, r.action) for r in url_lists.judge(captures, entries, "url", "at", ["id"]).collect())
    assert out == [(1, "b.c.d.e.f.g.h.i.org", "block"), (2, "b.c.d.e.f.g.h.i.org", "block"), (3, "i.org", "allow")]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_url_lists_within_a_day(spark, kind):
    def at(hour):
        return datetime.datetime(2024, 3, 1, hour)

    rows = [(k, "https://a.example.com/x", at(h)) for k, h in enumerate((7, 8, 9, 12, 20))]
    captures = spark.createDataFrame(rows, "id int, url string, at timestamp_ntz").withColumn("at", F.col("at").cast(kind))
    entries = spark.createDataFrame([("example.com", at(8), "block"), ("example.com", at(12), "allow"), ("a.example.com", at(18), "review"), ("example.com", at(12), "allow")],
                                    "name string, dated timestamp_ntz, action string").withColumn("dated", F.col("dated").cast(kind))
    out = url_lists.judge(captures, entries, "url", "at", ["id"])
    assert dict(out.dtypes)["since"] == kind
    assert [r.action for r in out.orderBy("id").collect()] == ["none", "block", "block", "allow", "review"]


def test_quality_of_looped_texts(spark):
    rnd = random.Random(4)
    pool = [a + b for a in ("wa", "ni", "lo", "ste", "ri", "tre") for b in ("ter", "ght", "ne", "ver", "wly", "nd", "ll")]

    def prose(n):
        return ". ".join(" ".join(rnd.sample(pool, 8)).capitalize() for _ in range(n)) + "."

    loops = [lambda: " ".join([prose(1)] * 12), lambda: " ".join([rnd.choice(["Buy cheap", "Get free", "Take red"]) + " pills now."] * 30), lambda: "\n".join([prose(14)] * 4)]
    rows = [(k, loops[k // 8 % 3]() if k % 8 == 0 else prose(rnd.randint(6, 40)), "en") for k in range(480)]
    wrong = [(r.doc_id, r.score, r.weak_posterior) for r in quality.classify(docs_of(spark, rows)).collect() if r.quality != (0 if r.doc_id % 8 == 0 else 1)]
    assert wrong == []


def test_url_lists_of_addresses_and_final_dots(spark):
    day = datetime.date
    entries = spark.createDataFrame([("[2001:db8::1]", day(2024, 1, 1), "block"), ("Ex.com.", day(2024, 1, 1), "block"), (" ex.com ", day(2024, 2, 1), "allow"), ("", day(2024, 1, 1), "block")],
                                    "name string, dated date, action string")
    rows = [(1, "http://[2001:db8::1]:80/x"), (2, "http://[2001:db8::2]/x"), (3, "https://a@www.EX.com.:8080/"), (4, "ftp://ex.com?x"), (5, "http://[2001:db8::1"), (6, "http://:80/")]
    captures = spark.createDataFrame([(i, u, d) for i, u in rows for d in (day(2024, 1, 15), day(2024, 3, 1))], "id int, url string, at date")
    out = {(r.id, r["at"].month): (r.host, r.matched_name, r.action) for r in url_lists.judge(captures, entries, "url", "at", ["id", "at"]).collect()}
    assert out[1, 1] == ("[2001:db8::1]", "[2001:db8::1]", "block") and out[2, 1] == ("[2001:db8::2]", None, "none")
    assert out[3, 1] == ("www.ex.com", "ex.com", "block") and out[3, 3] == ("www.ex.com", "ex.com", "allow") and out[4, 3][2] == "allow"
    assert out[5, 1][2] == out[6, 1][2] == "none"
    with pytest.raises(ValueError, match="host"):
        url_lists.judge(captures, entries, "url", "at", ["id", "host"])


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_url_lists_as_of_against_a_plain_search(spark, kind, monkeypatch):
    """A third of all captures on one host, entries and captures on and between the same times."""
    rnd = random.Random(6)
    begin = datetime.datetime(2024, 1, 1)

    def time():
        t = begin + datetime.timedelta(days=rnd.randint(0, 40), hours=rnd.choice([0, 6, 18]))
        return t.date() if kind == "date" else t

    hosts = ["www.hot.example.com"] * 5 + [f"h{k}.{d}" for k in range(5) for d in ("example.com", "a.b.co.uk")]
    captures = [(k, f"https://{rnd.choice(hosts)}/p{k}", time()) for k in range(400)]
    entries = [(rnd.choice(["com", "example.com", "hot.example.com", "www.hot.example.com", "b.co.uk", "nowhere.org"]), time(), rnd.choice(["block", "allow", "review", "other"])) for _ in range(60)]
    out = url_lists.judge(spark.createDataFrame(captures, f"id int, url string, at {kind}"), spark.createDataFrame(entries, f"name string, dated {kind}, action string"), "url", "at", ["id"])
    order = {"block": 0, "review": 1, "allow": 2, "other": 3}
    want = {}
    for i, url, t in captures:
        host = url.split("/")[2]
        for name in [host[j:] for j in range(len(host)) if j == 0 or host[j - 1] == "."]:
            valid = [(d, -order[a], a) for n, d, a in entries if n == name and d <= t]
            if valid:
                want[i] = (name, max(valid)[2], max(valid)[0])
                break
    assert {r.id: (r.matched_name, r.action, r.since) for r in out.collect()} == {i: want.get(i, (None, "none", None)) for i, _, _ in captures}


@pytest.mark.parametrize("block_rows", [1024, 4])
def test_near_duplicates_of_a_chain(spark, monkeypatch, block_rows):
    """Sets that meet only over others, and unlinked sets that share their rare shingles."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)
    pool = [f"w{k}" for k in range(2000)]
    rows = [(k, " ".join(pool[3 * k:3 * k + 30]), "en") for k in range(80)] + [(200 + k, " ".join(pool[3 * k:3 * k + 30] + ["end"]), "en") for k in range(0, 80, 7)]
    rows += [(400 + k, " ".join(pool[1000:1012] + pool[1100 + 9 * k:1109 + 9 * k] + pool[1100 + 9 * (k // 2):1109 + 9 * (k // 2)]), "en") for k in range(40)]
    found = jaccard.near_duplicates(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows)


def test_bpe_of_every_sign():
    """Letters, numbers, white space and capitals are those of the tokenizers library, whatever tables Python has."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    known, own = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.read_vocabulary(path))
    for first in range(0, 0x30000, 32):
        text = " ".join(f"a1 {chr(c)}b {chr(c)}!" for c in range(first, first + 32) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(own.encode(text)[0], "<u4").tolist() == known.encode(text, add_special_tokens=False).ids, hex(first)


def test_counts_over_several_splits(spark, rows, monkeypatch):
    """Ranges that are split again and again give the same sums, and entries grow with the corpus alone."""
    from careerspark.llm import counting
    from careerspark.llm.common import saved

    def found(docs):
        return (Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()),
                sorted((r.doc_id or 0, round(r.score, 9), r.n_known, r.train_tokens) for r in lm_score.score_texts(docs, learn=F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 0).collect()))

    docs = docs_of(spark, rows)
    plain = found(docs)
    written = []
    monkeypatch.setattr(counting, "saved", lambda df, name: written.append((name, saved(df, name))) or written[-1][1])
    for name, value in (("BATCH_WORDS", 300), ("PART_KEYS", 40), ("FAN", 4), ("GROUP", 3)):
        monkeypatch.setattr(counting, name, value)
    assert found(docs) == plain
    assert len([n for n, _ in written if n == "jaccard-counts-asked"]) >= 2
    per_batch = []
    for times in (1, 4):
        written.clear()
        many = docs_of(spark, [(1000 * t + (i or 0), " ".join(w + str(t) for w in text.split()) if text else text, lang) for t in range(times) for i, text, lang in rows])
        jaccard.near_duplicates(many)
        batches = next(df for n, df in written if n == "jaccard-batches").count()
        first = next(df for n, df in written if n == "jaccard-counts-asked").count()
        per_batch.append(first / batches)
    assert max(per_batch) <= 4
