"""Token counts of prefixes against the tokenizers library."""

import random

import pytest

from careerspark.llm import prefix_tokens

tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, n_tokens int, _text string, changes string"


@pytest.fixture(scope="module")
def known():
    library = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return prefix_tokens.Counter(prefix_tokens.read_vocabulary(PATH))


def test_every_prefix(counter, known):
    rnd = random.Random(3)
    parts = ["a", "e", "th", "ing", "'s", "'re", "'ll", "'", "r", "  ", " ", "\n", "\t", "1", "23", "!", "--", "...", "é", "ß", "日本", "😀", "́",
             "<|endoftext|>", "<|endof", "|>", "the ", "\r\n", "\x1c", "\u0085", "　", "aaaaaaa", "ÃÂÃÂ"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        changes = counter.text(text)
        counts = prefix_tokens.counts_at(changes).tolist()
        assert len(changes) == len(text.encode())
        tokens = [known(text[:i]) for i in range(len(text) + 1)]
        assert [counts[len(text[:i].encode())] for i in range(len(text) + 1)] == tokens
        for budget in (0, 1, 3, 7):
            cut = prefix_tokens.cut_text(text, prefix_tokens.cut_at(changes, [budget])[0])
            assert len(cut) == max(i for i, n in enumerate(tokens) if n <= budget)


def test_signs_of_every_class(counter, known):
    for first in range(0, 0x30000, 64):
        text = "".join(f"a1 {chr(c)}b" for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert counter.text(text) == b"" or prefix_tokens.counts_at(counter.text(text))[-1] == known(text), hex(first)


def test_documents(spark, known):
    texts = ["", " \n", "two words", "x" * 70_000, "the river " * 30_000, "  <|endoftext|><|endoftext|> end", "repeated", "repeated"]
    rows = [(k, t, "en", 1, "y", "z") for k, t in enumerate(texts)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    counted = prefix_tokens.prefix_counts(docs, PATH, budgets=[2, 100_000], keep=["doc_id", "lang"])
    out = {r.doc_id: r for r in counted.collect()}
    for k, t in enumerate(texts):
        assert (out[k].n_bytes, out[k].n_tokens) == (len(t.encode()), known(t)) and out[k].cuts[1] == len(t.encode())
    assert (out[None].n_bytes, out[None].n_tokens, out[None].cuts) == (0, 0, [0, 0])
    again = {r.doc_id: r.cuts for r in prefix_tokens.cuts(counted, [2, 100_000, 0]).collect()}
    assert all(again[i] == [*out[i].cuts, 0] for i in out)
    assert prefix_tokens.prefix_counts(docs.filter("false"), PATH).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        prefix_tokens.prefix_counts(docs, PATH, keep=["n_tokens"])


def test_short_running_sums(monkeypatch, counter):
    text = "the river runs, " * 50
    whole = prefix_tokens.cut_at(counter.text(text), [0, 5, 60, 10_000])
    monkeypatch.setattr(prefix_tokens, "CHANGE", 16)
    assert prefix_tokens.cut_at(counter.text(text), [0, 5, 60, 10_000]) == whole
