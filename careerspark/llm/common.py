"""What several operators share: the shared folder, tables, word hashes, packed arrays."""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import session_stages

CHUNK_BYTES = 2_000_000     # text hashed at once in a Python worker; a longer text is a chunk of its own


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again; its rows no longer depend on earlier stages. It is removed when
    the driver's program ends."""
    return session_stages(df.sparkSession).write(df, name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


# ---- classes of signs -------------------------------------------------------

#: Fixed values of the format: the signs that are white space, as ranges of code points.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Letters and numbers that Unicode 16 has over Unicode 15.1, the tables of the Python used here.
LATER = {
    "L": ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
          (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
          (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}


def ranges_of(kind: str) -> str:
    """The code points of letters (L) or numbers (N) in Unicode 16, as ranges of a character class."""
    later = [c for first, last in LATER[kind] for c in range(first, last + 1)]
    return code_ranges([*(c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind), *later])


def code_ranges(codes: Iterable[int]) -> str:
    """Code points as ranges of a character class."""
    inside = np.zeros(0x110000, np.int8)
    inside[list(codes)] = 1
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


# ---- strings of an Arrow column --------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows after one another, and where each row starts (one more entry than rows)."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads the bits of a 64-bit number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))    # one number per byte
LETTER[65:91] = LETTER[97:123]                                          # A-Z count as a-z
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK_BYTES), base, np.uint64)
            p[0] = 1
            POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return POWERS["up"][:n], POWERS["down"][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each word: runs of bytes other than space and 0x09 to 0x0D, within a text."""
    inside = IN_WORD[data]
    starts = offsets[:-1][np.diff(offsets) > 0]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[starts] = False
    after[starts[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of some texts, A-Z lower-cased, and the number of words of each text.

    The hash is a polynomial over the bytes, taken from running sums, so no Python code runs per word.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    first, last = word_spans(data, offsets)
    up, down = _powers(len(data))
    sums = np.cumsum(LETTER[data] * up, dtype=np.uint64)
    head = np.where(first > 0, sums[first - 1], np.uint64(0))
    words = np.diff(np.searchsorted(first, offsets))
    return mixed((sums[last] - head) * down[first]), words


# ---- packed arrays ---------------------------------------------------------


def narrow(a: np.ndarray) -> np.ndarray:
    """The same unsigned numbers in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def pack(a: np.ndarray) -> bytes:
    """Bytes of the same rank side by side, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return struct.pack("<qB", len(a), a.itemsize) + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, size = struct.unpack_from("<qB", blob)
    if not n:
        return np.zeros(0, f"u{size}")
    raw = pa.Codec("zstd").decompress(blob[9:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"u{size}").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)
