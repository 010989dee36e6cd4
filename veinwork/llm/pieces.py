"""Vectorised pre-tokenizer of byte-level BPE, and a cache of encoded pieces.

``split`` finds the matches of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
for a whole run of documents at once, from the character class of every code
point.  ``PieceCache`` then encodes each distinct piece once.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from veinwork.llm.textbatch import _EXACT, _EXACT2, ragged, span_hashes

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Code points with the property White_Space (fixed values of Unicode).
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[_SPACES] = _SPACE
    return table


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every piece, and pieces per document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    cp = code_points(data)
    n = len(cp)
    ascii_only = n == len(data)
    if ascii_only:
        doc_at = offsets
    else:
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        doc_at = leads[offsets]
    kind = _classes()[cp]
    begins = np.zeros(n + 1, bool)
    begins[doc_at] = True
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= begins[:n]
    blank = kind == _SPACE
    # a run of spaces that other characters follow gives up its last one
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~begins[1:n])
    first[last] = True
    first[last[cp[last] == 0x20] + 1] = False
    quotes = np.flatnonzero((cp == 0x27) & first)
    if len(quotes):
        doc_end = doc_at[np.searchsorted(doc_at, quotes, "right")]
        padded = np.concatenate([cp, np.zeros(2, np.uint32)])
        a = np.where(quotes + 1 < doc_end, padded[quotes + 1], 0)
        b = np.where(quotes + 2 < doc_end, padded[np.minimum(quotes + 2, n)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = one | two
        at = quotes[hit]
        first[at + 1] = False
        after = at + 2 + two[hit]
        first[after[after < n]] = True
    start = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(start, doc_at))
    if not ascii_only:
        start = np.flatnonzero((data & 0xC0) != 0x80)[start]
    return start, np.append(start[1:], len(data)), counts


class PieceCache:
    """Ids of pieces, each distinct piece encoded once; emptied when it holds ``limit`` pieces.

    Pieces are found by a 64-bit hash and confirmed by a second one and their
    length; should two pieces ever share the first, that run is encoded piece
    by piece.
    """

    def __init__(self, encode: Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 3_000_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _store(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.checks = np.insert(self.checks, at, checks)
        self.begin = np.insert(self.begin, at, begin)
        self.length = np.insert(self.length, at, lengths)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = (ends - starts).astype(np.uint64)
        h = span_hashes(data, starts, ends, _EXACT)
        check = span_hashes(data, starts, ends, _EXACT2) ^ size
        keys, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
        own = check[rep]
        if not np.array_equal(own[inverse], check):
            return self._each(data, starts, ends)
        if len(self.keys) + len(keys) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not np.array_equal(self.checks[at[known]], own[known]):
            return self._each(data, starts, ends)
        miss = rep[~known]
        if len(miss):
            raw = data.tobytes()
            flat, lengths = self.encode([raw[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist())])
            self._store(keys[~known], own[~known], flat, lengths)
            at = np.searchsorted(self.keys, keys)
        begin, length = self.begin[at][inverse], self.length[at][inverse]
        return self.pool[ragged(begin, length)], length

    def _each(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
