"""An FM-index over the words of one shard: counting, and locating, phrases.

Symbols are small integers; 0 stands wherever no phrase can run: between texts
and for words that no phrase holds. Every 0 is a symbol of its own, so suffixes
differ at the end of their stretch at the latest and nothing is read across it.
"""

from __future__ import annotations

import numpy as np

#: Every so many symbols a suffix's position is kept; a search walks back to one.
SAMPLED = 8


class Bits:
    """A row of bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self._words = np.zeros(len(bits) // 64 + 1, "<u8")
        self._words.view(np.uint8)[:len(packed)] = packed
        counts = np.bitwise_count(self._words).astype(np.int64)
        self._before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self._words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelets:
    """Symbols as bit rows, the highest bit first, each row dealt by the one before."""

    def __init__(self, symbols: np.ndarray, most: int):
        self._levels = []
        for shift in range(max(1, int(most).bit_length()) - 1, -1, -1):
            one = ((symbols >> shift) & 1).astype(bool)
            bits = Bits(one)
            self._levels.append((shift, bits, len(symbols) - bits.ones))
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self._start = self._down(np.arange(most + 1), np.zeros(most + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self._levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``i``."""
        return self._down(symbol, i) - self._start[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at place ``i``, its occurrences before)."""
        symbol = np.zeros(len(i), np.int64)
        for _, bits, zeros in self._levels:
            one, ones = bits.at(i), bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self._start[symbol]


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of every suffix, by doubling the compared length; only suffixes
    that still tie are sorted again."""
    n = len(text)
    rank = np.empty(n, np.int64)
    ends = np.flatnonzero(text == 0)
    rank[ends] = np.arange(len(ends))
    tied = np.flatnonzero(text)
    tied = tied[np.argsort(text[tied], kind="stable")]
    rank[tied] = len(ends) + _heads(text[tied])
    length = 1
    while True:
        r = rank[tied]
        differs = np.concatenate(([True], r[1:] != r[:-1], [True]))
        tied = tied[~(differs[:-1] & differs[1:])]
        if not len(tied):
            return rank
        key = rank[tied] * n + rank[tied + length]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = rank[tied]
        rank[tied] = old + _heads(key) - _heads(old)
        length *= 2


def _heads(values: np.ndarray) -> np.ndarray:
    """For each of sorted values the place of the first equal one."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0)) if len(values) else np.zeros(0, np.int64)


class Index:
    """``text`` ends with 0; symbols are 0 to ``most``."""

    def __init__(self, text: np.ndarray, most: int):
        rank = suffix_ranks(text)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        before = text[order - 1]
        before[order == 0] = 0
        self._tree = Wavelets(before, most)
        counts = np.bincount(text, minlength=most + 1)
        self._first = np.cumsum(counts) - counts
        kept = (order % SAMPLED == 0) | (before == 0)
        self._kept, self._places = Bits(kept), order[kept]
        self._n = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of suffixes that begin with each phrase,
        a row of symbols aligned to the right, -1 before its first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self._n)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = live[phrases[live, j] >= 0]
            symbol = phrases[live, j]
            low[live] = self._first[symbol] + self._tree.rank(symbol, low[live])
            high[live] = self._first[symbol] + self._tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``: steps back to a sampled one."""
        place, steps = np.empty(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self._kept.at(rows)
            place[open_[done]] = self._places[self._kept.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, seen = self._tree.at(rows)
            rows = self._first[symbol] + seen
            steps += 1
        return place
