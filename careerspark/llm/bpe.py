"""Byte-pair encoding with a tokenization automaton.

The automaton accepts exactly the token sequences that the merges produce. It starts with one state and an arc for each
single sign, and each merge (u, v) -> w adds a gadget: the state after u loses its arc v; wherever there is an arc u,
there is now an arc w as well; and the state after w has the arcs of the state after v. States are thus one per token.
A gadget copies a row and a column of the transition table, so copies are kept as references with the time of copying
(``Automaton``): the table of 49,000 tokens would have 2.4 billion entries, the references are as many as merges. An
entry is looked up by following references, and remembered.

Of all paths through this automaton one spells a word, but which arc to take shows only some signs later. It is therefore
made deterministic over signs (``Transitions``): a state of the table holds the token that ends at this sign and every
label begun before it that may still go on, with the token it would follow. Words are read along the table from left to
right, one entry a sign, without stepping back; each state names the token that ends there, and the arcs' labels are
emitted from the end of the word. States and entries are made when first asked for, by the arcs of the automaton, and kept
up to ``MOST_STATES``; then the table is begun anew. Decoding emits the labels of the arcs.

Results of odd rows: a null or empty text has no tokens and decodes to an empty text; repeated rows are encoded one by
one; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, code_ranges, ranges_of, slices, text_bytes

ENDED = 0x200              # added to the code of a word's last sign
START = (1 << 20) - 1      # the state before the first token; tokens have smaller numbers
REMEMBERED_ARCS = 500_000
MOST_STATES = 150_000
REMEMBERED_WORDS = 250_000
LONG_WORD = 64              # longer words are not remembered
#: Fixed values of the vocabulary file's format: how a text is split into words.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


#: Small letters of capitals that Unicode 16 and 17 have over the tables of the Python used here.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
         **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
SPACES = re.compile(f"[{WHITE}]+")


def word_patterns() -> tuple[re.Pattern, regex.Pattern, re.Pattern]:
    """Endings, runs of letters, single numbers, runs of other signs: a pattern with the classes of Unicode 16, a faster one
    with those of the ``regex`` module, and the signs on which the two, or small letters, differ."""
    letters, numbers = ranges_of("L"), ranges_of("N")
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    differ = set(LOWER)
    for kind, own in (("L", letters), ("N", numbers)):
        differ |= set(map(ord, regex.findall(rf"\p{{{kind}}}", every))) ^ set(map(ord, re.findall(f"[{own}]", every)))
    return (re.compile(f"{ENDINGS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+"),
            regex.compile(rf"{ENDINGS}|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"),
            re.compile(f"[{code_ranges(differ)}]") if differ else re.compile("(?!)"))


WORD, FAST_WORD, DIFFERENT = word_patterns()
PLAIN_WORD = re.compile(f"{ENDINGS}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")      # the same for texts of ASCII alone


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + k) for k, b in enumerate(rest)}}


def read_vocabulary(path: str) -> dict:
    """What the file says: ids by label, merges in order, special tokens, the suffix of word ends."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    return {"ids": model["vocab"], "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
            "special": {t["content"]: t["id"] for t in data["added_tokens"]}, "suffix": model["end_of_word_suffix"]}


class Automaton:
    def __init__(self, vocabulary: dict):
        ids = vocabulary["ids"]
        self.label = {i: t for t, i in ids.items()}
        self.born = dict.fromkeys(ids.values(), 0)      # the merge that made a token, from 1; 0 for single signs
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.lost: dict[tuple[int, int], int] = {}      # when the state after a token lost an arc
        for time, (a, b) in enumerate(vocabulary["merges"], 1):
            u, v, w = ids[a], ids[b], ids[a + b]
            self.lost.setdefault((u, v), time)
            if not self.born[w]:
                self.born[w], self.left[w], self.right[w] = time, u, v
        self.arcs: dict[int, bool] = {}

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after a token has an arc for another."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= REMEMBERED_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(state, token)
        return known

    def _arc(self, state: int, token: int) -> bool:
        born, lost, time = self.born, self.lost, 1 << 60
        while True:
            if lost.get((state, token), 1 << 61) < time:
                return False
            a, b = born[state], born[token]
            if a == b == 0:
                return True
            if a == b:                          # the same token twice: both copied in one step
                time, state, token = a, self.right[state], self.left[token]
            elif b > a:                         # the arc came with the token, where its left part had one; the
                time, token = b + 1, self.left[token]     # step that made it has taken the left part's own arc
            else:                               # the state came with its token, a copy of the right part's
                time, state = a, self.right[state]


def sign_codes(word: str) -> list[int]:
    """Codes of a word's byte signs, the last one marked."""
    codes = list(map(ord, word))
    codes[-1] += ENDED
    return codes


class Transitions:
    """The automaton, deterministic over signs: a table (state, sign) -> state, filled when an entry is first asked for."""

    def __init__(self, vocabulary: dict):
        self.automaton, suffix = Automaton(vocabulary), vocabulary["suffix"]
        self.size: dict[int, int] = {}              # signs of each token
        self.begun: dict[int, int] = {}             # the label begun by another and one more sign
        self.whole = [-1]                           # the token that a begun label is
        self.goes_on = [True]                       # whether longer labels begin with it
        for label, token in vocabulary["ids"].items():
            codes = sign_codes(label[:-len(suffix)]) if label.endswith(suffix) and label != suffix else list(map(ord, label))
            self.size[token], node = len(codes), 0
            for code in codes:
                self.goes_on[node] = True
                node = self.begun.setdefault(node << 10 | code, len(self.whole))
                if node == len(self.whole):
                    self.whole.append(-1)
                    self.goes_on.append(False)
            self.whole[node] = token
        self.restart()

    def restart(self) -> None:
        self.number = {(START,): 0}                 # of each state, by its begun labels and the tokens they follow
        self.parts = [(START,)]
        self.rows: list[dict[int, int]] = [{}]

    def entry(self, state: int, code: int) -> int:
        """The state that a sign leads to."""
        token, parts = -1, []
        for part in self.parts[state]:
            node, follows = self.begun.get(part >> 20 << 10 | code), part & START
            if node is not None:
                whole = self.whole[node]
                if whole >= 0 and token < 0 and (follows == START or self.automaton.arc(follows, whole)):
                    token = whole
                if self.goes_on[node]:
                    parts.append(node << 20 | follows)
        if token < 0:
            raise ValueError(f"no token ends with the sign {chr(code % ENDED)!r}")
        key = (*parts, token)                       # the last part begins nothing yet and follows the token that ends here
        row, to = self.rows[state], self.number.get(key)
        if to is None:
            if len(self.parts) >= MOST_STATES:      # within a long word too
                self.restart()
            to = self.number[key] = len(self.parts)
            self.parts.append(key)
            self.rows.append({})
        row[code] = to
        return to

    def path(self, word: str) -> list[int]:
        """Tokens of a word, given as byte signs."""
        state, ending = 0, []
        for code in sign_codes(word):
            to = self.rows[state].get(code)
            state = self.entry(state, code) if to is None else to
            ending.append(self.parts[state][-1])
        out, i = [], len(ending)
        while i:
            out.append(ending[i - 1])
            i -= self.size[out[-1]]
        return out[::-1]


class Words(dict):
    """Ids (4 bytes each) and labels of words, found when first asked for."""

    def __init__(self, transitions: Transitions):
        super().__init__()
        self.transitions, self.signs, self.older = transitions, byte_signs(), {}
        self.labels = transitions.automaton.label
        self.bytes = {i: i.to_bytes(4, "little") for i in self.labels}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        known = self.older.get(word)
        if known:
            return self.kept(word, known)
        plain = word.isascii() and word.isalnum()
        path = self.transitions.path(word if plain else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs))
        out = b"".join(map(self.bytes.__getitem__, path)), " ".join(map(self.labels.__getitem__, path))
        return self.kept(word, out)

    def kept(self, word: str, out: tuple[bytes, str]) -> tuple[bytes, str]:
        """Of full memories the last one is kept too, so frequent words stay."""
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


def split_words(text: str) -> list[str]:
    """Words of a text in normal form C and lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = SPACES.sub(" ", text).replace("Σ", "σ")     # letters are lower-cased one by one
        return WORD.findall(text.translate(LOWER).lower()) if DIFFERENT.search(text) else FAST_WORD.findall(text.lower())
    return PLAIN_WORD.findall(text.lower())


class Encoder:
    def __init__(self, vocabulary: dict):
        special = vocabulary["special"]
        self.special = {t: (np.array([i], "<u4").tobytes(), t) for t, i in special.items()}
        self.words = Words(Transitions(vocabulary))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text, 4 bytes each, and the text that they decode to."""
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        found: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
            else:
                found += map(self.words.__getitem__, split_words(part))
        if not found:
            return b"", ""
        ids, labels = zip(*found)
        return b"".join(ids), " ".join(labels)


def encode_texts(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Encodes and decodes each text with the vocabulary file at ``path`` (read on the driver).

    Returns the columns ``keep`` (doc_id if not given), ids (4 bytes each, little end first) and decoded.
    """
    return _mapped(docs, path, keep, text, "ids binary, decoded string",
                   lambda ids, decoded: [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())])


def digest_texts(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """As ``encode_texts``, but n_tokens and the SHA-256 of ids and decoded text, made where the text is."""
    return _mapped(docs, path, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: [
        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded])])


def _mapped(docs: DataFrame, path: str, keep: list[str] | None, text: str, columns: str, made) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))      # bounded by the vocabulary
    fields = docs.select(*(keep or ["doc_id"]), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = fields.drop("_text").schema
    for column in columns.split(", "):
        name, kind = column.split(" ")
        schema = schema.add(name, kind)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in shipped.value:      # a worker keeps the broadcast from task to task, and the words it has encoded
            shipped.value["encoder"] = Encoder(shipped.value)
        encoder = shipped.value["encoder"]
        for batch in batches:
            last = batch.num_columns - 1
            _, offsets = text_bytes(batch.column(last))
            for i, j in slices(offsets):
                pairs = [encoder.encode(t) for t in batch.column(last).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in range(last)],
                     *made([p[0] for p in pairs], [p[1] for p in pairs])], names=names)

    return fields.mapInArrow(run, schema)
