"""Vectorised text kernels shared by the operators.

A batch of Arrow strings becomes one array of code points; words, word hashes
and hashes of word n-grams then come from table look-ups and prefix sums, so no
Python loop runs per character or per word. A word is a maximal run of
alphanumeric code points, compared in lower case. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_TABLE = 0x20000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Code points that one slice of a batch may hold; longer texts form a slice of their own, which is worked on in pieces of about this size.
SLICE_CHARS = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _values(seed: int = 0) -> np.ndarray:
    """A random value for each alphanumeric code point, 0 for all others; both cases share a value."""
    lower = np.zeros(_TABLE, np.uint64)
    for c in range(_TABLE):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            lower[c] = ord(low[0]) if len(low) == 1 else c
    out = mix64(lower * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019 + seed))
    out[out == 0] = 1
    out[lower == 0] = 0
    return out


@lru_cache(maxsize=1)
def _power_table() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        a = np.full(SLICE_CHARS + 4096, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of one slice are kept, longer ones are made for the call."""
    if n <= SLICE_CHARS + 4096:
        return _power_table()
    out = []
    for base in (_BASE, _BASE_INV):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


class Words(NamedTuple):
    """The words of some rows: row i has those from splits[i] to splits[i + 1]."""

    rows: tuple[int, int]
    hashes: np.ndarray
    splits: np.ndarray

    def ends(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return np.repeat(self.splits[1:], np.diff(self.splits))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.splits) - 1), np.diff(self.splits))


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` characters, or one row."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by a line feed, and where each text begins (one more at the end)."""
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    joined = "\n".join([t or "" for t in texts] + [""])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.concatenate(([0], np.cumsum(lengths)))


def cuts(text: str, at: Callable[[str], bool], size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a text of about ``size`` characters each; but for the last, each ends after a character of which ``at`` holds."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        while hi < len(text) and not at(text[hi - 1]):
            hi += 1
        yield lo, hi
        lo = hi


def _hash_words(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more at the end)."""
    values = _values(seed)
    cps, begins = code_points(texts)
    n = len(cps)
    p, q = _powers(n + 1)
    if n and int(cps.max()) >= _TABLE:
        v = np.where(cps < _TABLE, values[np.minimum(cps, _TABLE - 1)], mix64(cps.astype(np.uint64) + np.uint64(seed)))
    else:
        v = values[cps]
    is_word = v != 0
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if n and is_word[0]:
        edge = np.concatenate(([0], edge))
    s, e = edge[0::2], edge[1::2]  # a line feed ends the last word
    v *= p[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    return mix64((total[e] - total[s]) * q[s]), np.searchsorted(s, begins).astype(np.int64)


def words(column: pa.Array | pa.ChunkedArray, seed: int = 0) -> Iterator[Words]:
    """Hashes of all words of a string column, slice by slice; another seed gives hashes that share no collision. A long text's words are made piece by piece, so only their hashes are held whole."""
    texts = column.to_pylist()
    for lo, hi in slices(texts):
        text = texts[lo]
        if hi == lo + 1 and text and len(text) > SLICE_CHARS:
            parts = [_hash_words([text[a:z]], seed)[0] for a, z in cuts(text, lambda c: ord(c) < _TABLE and not c.isalnum())]
            h = np.concatenate(parts)
            yield Words((lo, hi), h, np.array([0, len(h)], np.int64))
            continue
        yield Words((lo, hi), *_hash_words(texts[lo:hi], seed))


def spans(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of runs of entries of ``h``, one for each start and length; no run may be empty."""
    p, q = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix64((total[starts + lengths] - total[starts]) * q[starts] + lengths.astype(np.uint64))


def ngrams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words, across rows too; the caller drops those that cross."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > SLICE_CHARS:
        return np.concatenate([ngrams(h[a : min(n, a + SLICE_CHARS) + k - 1], k, seed) for a in range(0, n, SLICE_CHARS)])
    p, q = _powers(len(h) + 1)
    x = mix64(h + np.uint64(seed)) if seed else h
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(x * p[: len(h)], out=total[1:])
    return mix64((total[k:] - total[:-k]) * q[:n] + np.uint64(k))


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least value of each window of w entries."""
    if len(a) < w:
        return a[:0]
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    if size < w:
        a = np.minimum(a[: len(a) - (w - size)], a[w - size :])
    return a


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all entries of the runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column over one buffer; lengths are in entries of ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * data.itemsize, out=offsets[1:])
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
