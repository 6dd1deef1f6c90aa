"""Helpers shared by the training-data operators: shared scratch tables and numpy text hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscope.sources.stage import scratch, shared_dir, staged

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.frombuffer(LOWER, np.uint8)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
SEGMENT = 1 << 20


BITMAP_BITS = 1 << 25


def maybe_among(ids: DataFrame, *keys: str) -> Callable[..., Column]:
    """A test by which rows of a large table can be kept from a shuffle: false only for keys that ids does not hold.

    It is a bitmap of a fixed 4 MB over a hash of the keys. The larger ids is, the more strangers pass, and a join after it sorts
    those out; its size never changes.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS))
    words = ids.select(h.alias("h")).selectExpr("cast(h div 32 as int) as w", "shiftleft(1L, cast(h % 32 as int)) as b")
    bits = np.zeros(BITMAP_BITS // 32, np.uint32)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most a row for each word of the bitmap
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return lambda *cols: test(F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS)))


def merged(df: DataFrame, name: str) -> DataFrame:
    """staged for what is joined again and again: a broadcast of each small table, pages of some MB, would stay in the driver's heap until a collection."""
    return staged(df, name).hint("merge")


def utf8(col: str) -> Column:
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def columns(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column(i) for i in range(batch.num_columns)]


def byte_slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, or of a single row."""
    ends = np.cumsum(lengths)
    i, n = 0, len(lengths)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse, as long as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_MUL, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_INV, k, 1 << 64))])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums P with which span_hash gives the hash of any data[s:e]; sums wrap at 64 bits."""
    _Powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _Powers.up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((prefix[e] - prefix[s]) * _Powers.down[s] + (e - s).astype(np.uint64))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a buffer, A-Z lower-cased, and where each starts."""
    data = _LOW[np.frombuffer(buffer, np.uint8)]
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hash(prefix_hash(data), s, e), s


def segments(text: bytes, limit: int = SEGMENT) -> Iterator[bytes]:
    """Pieces of a long text, cut at a blank so that no word is cut."""
    i, n = 0, len(text)
    while n - i > limit:
        j = i + limit
        while j < n and not _SPACE[text[j]]:
            j += 1
        yield text[i:j]
        i = j
    yield text[i:]


def words_by_text(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, hashes of its words in order), for every text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for i, j in byte_slices(lengths, SEGMENT):
        if j == i + 1 and lengths[i] > SEGMENT:
            yield i, np.concatenate([word_hashes(x)[0] for x in segments(texts[i])])
            continue
        h, s = word_hashes(b" ".join(texts[i:j]))
        at = np.searchsorted(s, np.concatenate([[0], np.cumsum(lengths[i:j] + 1)]))
        for k in range(i, j):
            yield k, h[at[k - i] : at[k - i + 1]]


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the whole sequence; of none, nothing."""
    if not len(h):
        return h
    k = min(size, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _SHINGLE[i]
    return np.unique(mix(total))
