"""Shared helpers: byte-level hashing in numpy, Arrow text access, and sizes of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.sources.shared import discard, shared_dir, stored  # noqa: F401

U = np.uint64
_A, _B, _C = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: A random 64-bit odd number for each byte value.
BYTE_HASH = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(docs: DataFrame, text: str, block_bytes: int, least: int = 64) -> int:
    """How many blocks of about block_bytes of text docs make."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-int(total) // block_bytes))


# ---------------------------------------------------------------- Arrow


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and the offsets of its rows (one more than rows). Null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, limit: int = 2 << 20):
    """Row ranges of about limit bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * _A
    x ^= x >> U(27)
    x = x * _B
    return x ^ (x >> U(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= x >> U(29)
    x += b * _B
    x ^= x >> U(32)
    return x


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each position on, by doubling; empty if there are fewer bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    h, k = BYTE_HASH[data], 1
    while k * 2 <= n:
        h, k = _join(h[:-k], h[k:]), k * 2
    return _join(h[: -(n - k)], h[n - k :]) if k < n else h


def window_min(p: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    k = 1
    while k * 2 <= w:
        p, k = np.minimum(p[:-k], p[k:]), k * 2
    return np.minimum(p[: -(w - k)], p[w - k :]) if k < w else p


_BASE, _UNBASE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 2**64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            x = np.full(n + n // 4, base, np.uint64)
            x[0] = 1
            _POW[k] = np.cumprod(x)
    return _POW[0][:n], _POW[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair: a polynomial taken from prefix sums."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * down[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64) * _C)


#: Bytes that make words: letters, digits and all bytes of characters outside ASCII.
WORD_BYTE = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each row's first word (one more than rows). Words don't cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w, cut = WORD_BYTE[data], np.zeros(n + 1, bool)
    cut[off] = True
    first = w.copy()
    first[1:] &= cut[1:n] | ~w[:-1]
    last = w.copy()
    last[:-1] &= cut[1:n] | ~w[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def words_of(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, each row's first word (one more than rows), and the rows' bytes."""
    data, off = flat(pc.utf8_lower(pc.fill_null(arr, "")))
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(off, 1 << 19):
        part = data[off[i] : off[j]]
        start, end, first = word_spans(part, off[i : j + 1] - off[i])
        hashes.append(span_hashes(part, start, end))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.diff(off)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n neighbouring words of a row, and the row of each; a row of 1 to n-1 words has one shingle of all of them."""
    rows = len(first) - 1
    count = np.diff(first)
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = _join(h, words[k : len(words) - n + 1 + k])
        row = np.repeat(np.arange(rows), count)[: len(h)]
        whole = np.arange(len(h)) + n <= first[row + 1]
        h, row = h[whole], row[whole]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for r in short:
            x = U(int(count[r]))
            for w in words[first[r] : first[r + 1]]:
                x = _join(np.array([x]), np.array([w]))[0]
            own.append(x)
        h, row = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def binary(parts: list) -> pa.Array:
    return pa.array(parts, pa.binary())
