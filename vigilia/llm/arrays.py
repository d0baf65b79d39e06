"""Words and their hashes for whole Arrow columns of text, as numpy arrays.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``;
UTF-8 continuation bytes never collide with those, so bytes split as code
points do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_LONG_WORD = 256
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair (a, b)."""
    return mix(a * _M1 + mix(b + _M1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, whole rows each, so
    that working memory follows ``limit`` and the longest text only."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right"))
        end = min(max(end - 1, start + 1), len(offsets) - 1)
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()  # a worker goes on to other stages


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words in order, and for each
    text the index of its first word, with the total at the end. ``space``
    marks the bytes between words."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """One uint64 hash per word, eight bytes at a time for all words at once."""
    lengths = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)
    h = mix(lengths.astype(U) * _M1 + U(1 + seed))
    alive = np.flatnonzero(lengths <= _LONG_WORD)
    at = 0
    while len(alive):
        rest = np.minimum(lengths[alive] - at, 8)
        h[alive] = mix(h[alive] * _M1 ^ (eights[starts[alive] + at] & masks[rest]))
        at += 8
        alive = alive[lengths[alive] > at]
    for i in np.flatnonzero(lengths > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = U(int.from_bytes(digest, "little"))
    return h


class Spans:
    """Hashes of any run of consecutive words, from prefix sums of a polynomial
    modulo 2**64 whose terms are the already mixed word hashes."""

    _BASE = 0xD6E8FEB86659FD93
    _INVERSE = pow(_BASE, -1, 2**64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        powers, self._back = self._powers(self._BASE, n), self._powers(self._INVERSE, n)
        self._sums = np.zeros(n, U)
        np.cumsum(hashes * powers[:-1], out=self._sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, U(base))
        out[0] = 1
        return np.cumprod(out)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = (self._sums[end] - self._sums[start]) * self._back[start]
        return mix(total + (end - start).astype(U) * _M1)


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = ~_ALNUM & ~SPACE & (np.arange(256) < 128)
_MARK[39] = False
_TAIL = 8


def without_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with ASCII marks at their ends made spans of their own, where
    an ASCII letter or digit or a Latin-1 letter stands before the marks: there
    every word pattern cuts. Apostrophes are not taken for marks."""
    cut = ends.copy()
    for _ in range(_TAIL):
        cut -= (cut > starts + 1) & _MARK[data[cut - 1]]
    if not len(cut):
        return starts, ends
    last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
    # The UTF-8 bytes of the multiplication and division signs.
    latin = (before == 0xC3) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= starts)
    fine = (cut < ends) & (_ALNUM[last] | latin)
    return np.sort(np.concatenate((starts, cut[fine]))), np.sort(np.concatenate((ends, cut[fine])))


def spliced(parts: np.ndarray, ends: np.ndarray, first: np.ndarray, special: dict[int, bytes]) -> list[bytes]:
    """The ids of each text as bytes: ``parts`` cut at its last chunk's end, or
    what ``special`` has for the text's number."""
    bounds = np.concatenate(([0], ends))[first] * 4
    data = parts.tobytes()
    out = [data[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    for i, ids in special.items():
        out[i] = ids
    return out
