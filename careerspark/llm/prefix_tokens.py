"""Token counts of every prefix of a text under a byte-level byte-pair vocabulary, by dynamic programming.

The tokens of a prefix are the tokens of a shorter prefix and one more, and that last token is the only one that ends
there and agrees with the token before it: two tokens agree if no merge that reaches over their border comes before the
merges that use up the sides. So one pass over a word gives the exact count at each of its prefixes. A word, with the
white space before it, is cut the same way whatever stands around it, so counts of words seen before are looked up, and
a text's counts are those of its words put end to end. They are kept as one signed byte per byte of text, the change
of the count; a running sum answers how many tokens any prefix has and where a text must be cut to fit a budget.

Inside a sign of several bytes the count is that of the text before the sign. A special string counts as one token from its
last byte on; before, its signs are ordinary ones, as they are to the tokenizer.

Results of odd rows: a null or empty text has no bytes, no tokens and no cuts but at 0; repeated rows are counted one by
one; a text of any length is counted whole, in pieces of words, with 1 byte of changes and 4 of running counts a byte
in memory (a single word of any length too). Extra columns are not read; ``keep`` must not name the result columns.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType

from .bpe import byte_signs
from .common import WHITE, ranges_of, slices, text_bytes

REMEMBERED = 400_000        # words and pairs of tokens of each kind kept in a worker
LONG_WORD = 64              # longer words are not remembered
CHANGE = 1 << 22            # changes that are summed at once


def read_vocabulary(path: str) -> dict:
    """Bytes of the tokens by id, merges in order, special strings. The file must be a plain byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, before = data["model"], data["pre_tokenizer"]
    if data["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    back = {s: b for b, s in byte_signs().items()}
    spelled = {t: bytes(back[s] for s in t) for t in model["vocab"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {"merges": [(spelled[a], spelled[b]) for a, b in pairs], "tokens": sorted(spelled.values()),
            "special": [t["content"] for t in data["added_tokens"]], "letters": ranges_of("L"), "numbers": ranges_of("N")}


class Counter:
    """Counts at the prefixes of words, texts. Tokens are named by their bytes."""

    def __init__(self, vocabulary: dict):
        self.tokens = set(vocabulary["tokens"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for time, pair in enumerate(vocabulary["merges"], 1):
            self.rank.setdefault(pair, time)
            self.parts.setdefault(pair[0] + pair[1], pair)
        if len(self.parts) < len(vocabulary["merges"]):
            raise ValueError("two merges make the same token")
        if len(self.tokens & {bytes([b]) for b in range(256)}) < 256:
            raise ValueError("the vocabulary lacks a byte")
        self.longest: dict[bytes, int] = {}         # of the tokens that end with two bytes
        for t in self.tokens:
            self.longest[t[-2:]] = max(len(t), self.longest.get(t[-2:], 0))
        self.edges: tuple[dict, dict] = {}, {}      # see ``edge``
        self.agreed: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.words = Words(self)
        white, letters, numbers = WHITE, vocabulary["letters"], vocabulary["numbers"]
        self.space = re.compile(f"[{white}]*")
        piece = f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]"
        self.piece = re.compile(f"[{white}]+(?![^{white}])|{piece}")
        self.word = re.compile(f"[{white}]{{2,}}[^{white}]*|{piece}")    # a split that what follows never changes
        special = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """Pieces at one end of a token while it is built, with the merge that uses each up; the token itself is last."""
        known = self.edges[right].get(token)
        if known is None:
            parts = self.parts.get(token)
            if parts is None:
                known = [(token, float("inf"))]
            else:
                inner = self.edge(parts[right], right)
                known = [*inner[:-1], (inner[-1][0], self.rank[parts]), (token, float("inf"))]
            self.edges[right][token] = known
        return known

    def apart(self, a: bytes, b: bytes, joined: bool = False) -> bool:
        """Whether no merge reaches over the border of ``a`` and ``b`` while they are built or, unless ``joined``, when
        both are there. Equal merges go from left to right: a piece on the left is used up by its own token before the
        border's merge of the same rank, one on the right after it."""
        ends, starts = self.edge(a, True), self.edge(b, False)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = ends[i], starts[j]
            complete = i == len(ends) - 1 and j == len(starts) - 1
            merge = None if complete and joined else self.rank.get((x, y))
            if merge is not None and merge < x_end and merge <= y_end:
                return False
            if complete:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def alone(self, token: bytes) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = self.whole[token] = parts is None or self.alone(parts[0]) and self.alone(parts[1]) and self.apart(*parts, joined=True)
        return known

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a piece that no word border cuts, the empty one first."""
        tokens, longest, agreed = self.tokens, self.longest, self.agreed
        n = [0] * (len(piece) + 1)
        last = [piece[:1]] * (len(piece) + 1)
        if piece:
            n[1] = 1                            # a byte alone is a token
        for i in range(2, len(piece) + 1):
            first = max(0, i - longest.get(piece[i - 2:i], 1))
            for start in range(first, i):
                t = piece[start:i]
                if t not in tokens:
                    continue
                if start:
                    fits = agreed.get((last[start], t))
                    if fits is None:
                        fits = agreed[last[start], t] = self.apart(last[start], t)
                else:
                    fits = self.alone(t)
                if fits:
                    n[i], last[i] = n[start] + 1, t
                    break
        if len(agreed) > REMEMBERED:
            agreed.clear()
        return n

    def changes(self, word: str) -> bytes:
        """Change of the count at each byte of a word, or of white space and all that follows it up to the next."""
        signs = word.encode("utf-8", "surrogatepass")
        total = self.counts(signs) if len(word) < 2 or self.space.match(word).end() < 2 else self.after_space(word, signs)
        if word[0] == "'" and word[1:] in ("re", "ve", "ll"):   # before the last letter is there, the first one stands alone
            total[2] = 2
        if not word.isascii():                                  # inside a sign, the count is that of the text before
            for i in range(1, len(signs)):
                if signs[i] & 0xC0 == 0x80:
                    total[i] = total[i - 1]
        try:
            return bytes(array("b", [b - a for a, b in zip(total, total[1:])]))
        except OverflowError:
            raise ValueError("a count changes by over 127 at one sign") from None

    def after_space(self, unit: str, signs: bytes) -> list[int]:
        """Tokens of each prefix of two white spaces or more and what follows. As long as only white space is there, it is
        one piece; then its last sign belongs to what follows, or stands alone."""
        space = self.space.match(unit).end()
        before = len(unit[:space].encode("utf-8", "surrogatepass"))
        total = self.counts(signs[:before])
        at = base = 0
        for m in self.piece.finditer(unit):
            piece = m.group().encode("utf-8", "surrogatepass")
            n = self.counts(piece)
            if m.end() > space:
                if m.group() in ("'re", "'ve", "'ll"):
                    n[2] = 2
                total += [base + x for x in n[max(at, before) - at + 1:]]
            base, at = base + n[-1], at + len(piece)
        return total

    def last_word(self, text: str) -> str:
        """The last word, with all white space before it or after it."""
        white, i = self.space.fullmatch, len(text)
        while i and not white(text[i - 1]):
            i -= 1
        while i and white(text[i - 1]):
            i -= 1
        return text[i:]

    def plain(self, text: str) -> bytes:
        """Changes of a text without special strings."""
        words = self.words
        if len(text) <= CHANGE:
            return b"".join(map(words.__getitem__, self.word.findall(text)))
        return b"".join(words[m.group()] for m in self.word.finditer(text))

    def text(self, text: str) -> bytes:
        """Changes of the count at each byte of a text; their sum is its number of tokens."""
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        out = []
        for k in range(0, len(parts), 2):
            out.append(self.plain(parts[k]))
            if k + 1 < len(parts):      # until it is complete, a special string goes on with the word before it
                unit = self.last_word(parts[k])
                so_far = self.plain(unit + parts[k + 1][:-1])
                had = len(unit.encode("utf-8", "surrogatepass"))
                rest = np.frombuffer(so_far[had:], np.int8).astype(np.int64)
                out += [so_far[had:], int(1 - rest.sum()).to_bytes(1, "little", signed=True)]
        return b"".join(out)


class Words(dict):
    """Changes of words, found when first asked for. Of full memories the last one is kept too, so frequent words stay."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter, self.older = counter, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word) or self.counter.changes(word)
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


def counts_at(changes: bytes) -> np.ndarray:
    """Tokens of every prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])


def cut_at(changes: bytes, budgets: Sequence[int]) -> list[int]:
    """For each budget, the bytes of the longest prefix with at most so many tokens. A prefix inside a sign counts as the
    text before the sign, so cuts are moved back to where the sign starts by ``cut_text``."""
    best, total = [0] * len(budgets), 0
    for i in range(0, len(changes), CHANGE):
        run = np.cumsum(np.frombuffer(changes, np.int8, min(CHANGE, len(changes) - i), i), dtype=np.int32)
        for k, budget in enumerate(budgets):
            last = np.flatnonzero(run <= budget - total)
            if len(last):
                best[k] = i + int(last[-1]) + 1
        total += int(run[-1])
    return best


def cut_text(text: str, n_bytes: int) -> str:
    """The text's first bytes, without a sign that is cut in two."""
    return text.encode("utf-8", "surrogatepass")[:n_bytes].decode("utf-8", "ignore")


def prefix_counts(docs: DataFrame, path: str, budgets: Sequence[int] = (), keep: Sequence[str] = ("doc_id",), text: str = "text",
                  store: bool = True) -> DataFrame:
    """The columns ``keep``, n_bytes, n_tokens, cuts (for each budget the bytes of the longest prefix that fits) and, if
    ``store``, changes, from which ``counts_at`` and ``cuts`` answer for any prefix and budget without encoding again.
    The vocabulary at ``path`` is read on the driver."""
    columns = {"n_bytes": LongType(), "n_tokens": LongType(), "cuts": ArrayType(LongType()), **({"changes": BinaryType()} if store else {})}
    clash = [c for c in keep if c in columns]
    if clash:
        raise ValueError(f"keep names result columns: {', '.join(clash)}")
    budgets = list(budgets)
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))       # bounded by the vocabulary
    return _mapped(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")), columns, lambda: _counting(shipped.value, budgets, store))


def _counting(vocabulary: dict, budgets: list[int], store: bool) -> Callable[[pa.Array], list[pa.Array]]:
    if "counter" not in vocabulary:     # a worker keeps the broadcast from task to task, and what was counted with it
        vocabulary["counter"] = Counter(vocabulary)
    counter = vocabulary["counter"]

    def over(texts: pa.Array) -> list[pa.Array]:
        found = [counter.text(t) for t in texts.to_pylist()]
        totals = [int(np.frombuffer(c, np.int8).sum(dtype=np.int64)) for c in found]
        fit = [cut_at(c, budgets) if budgets and n > min(budgets) else [len(c)] * len(budgets) for c, n in zip(found, totals)]
        return [pa.array(list(map(len, found)), pa.int64()), pa.array(totals, pa.int64()), pa.array(fit, pa.list_(pa.int64())),
                *([pa.array(found, pa.binary())] if store else [])]
    return over


def cuts(counted: DataFrame, budgets: Sequence[int], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For rows of ``prefix_counts``: the columns ``keep`` and cuts, for other budgets."""
    budgets = list(budgets)
    return _mapped(counted.select(*keep, F.coalesce("changes", F.lit(b"")).alias("_text")), {"cuts": ArrayType(LongType())},
                   lambda: lambda rows: [pa.array([cut_at(c, budgets) for c in rows.to_pylist()], pa.list_(pa.int64()))])


def _mapped(fields: DataFrame, columns: dict[str, DataType], made: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """The columns before the last, and what is made of the last, a few rows at a time."""
    schema = fields.drop("_text").schema
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = made()
        for batch in batches:
            last = batch.num_columns - 1
            _, offsets = text_bytes(batch.column(last))
            for i, j in slices(offsets):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(last)], *make(batch.column(last).slice(i, j - i))], names=names)

    return fields.mapInArrow(run, schema)
