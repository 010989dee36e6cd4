"""Vectorised text primitives over Arrow string columns.

A batch of texts is one ``uint8`` buffer plus document offsets, so words,
word hashes and shingles of a whole batch come from a handful of numpy passes
without building Python strings.  Nulls count as empty texts.  Work is cut in
runs of documents of about ``CHUNK`` bytes; a longer document is a run of its
own, so a batch never needs more than a small multiple of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SHINGLE = 5

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _EXACT.copy()
_LOWER[ord("A") : ord("Z") + 1] = _LOWER[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        grown = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        if size > CHUNK * 8:
            return grown[0], grown[1]
        _POWERS = (grown[0], grown[1])
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, raw, data = column.buffers()
    if n == 0 or raw is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    values = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return values, offsets - first


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words each document has."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = _WS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _LOWER) -> np.ndarray:
    """64-bit content hash of each span; ``_LOWER`` folds A-Z."""
    n = len(data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word in order, and words per document."""
    starts, ends, counts = spans(data, offsets)
    return span_hashes(data, starts, ends), counts


_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 2**64)) for k in range(64)]


def shingles(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each document in text order, and shingles per document.

    A document of fewer than ``width`` words has its whole sequence as its one
    shingle; a document without words has none.
    """
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not len(words):
        return np.zeros(0, np.uint64), made
    ends = np.cumsum(counts)
    begin = ends - counts
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total += padded[k : k + len(words)] * _STEP[k + 1]
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words)) - begin[doc]
    keep = at < made[doc]
    out = total[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        where = np.cumsum(made) - made
        for d in short:
            own = words[begin[d] : ends[d]]
            out[where[d]] = sum(int(w) * int(_STEP[k + 1]) for k, w in enumerate(own)) % 2**64 ^ int(counts[d])
    return mix(out), made


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... for runs of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
