"""What a worker remembers of the chunks of text it has met."""

from __future__ import annotations

import numpy as np

from vigilia.llm.arrays import U


class Remembered:
    """Token ids of chunks, found by the chunks' 64-bit hashes for whole arrays.

    At most ``most`` chunks are held; then all are forgotten and met anew, so
    memory is bounded for any number of distinct chunks.
    """

    def __init__(self, most: int):
        self._most = most
        self._bits = int(2 * most).bit_length()
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << self._bits, U)
        self._entry = np.zeros(1 << self._bits, np.int32)
        self._start, self._size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._ids = np.zeros(4096, "<u4")
        self._count, self._used = 0, 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or -1, slot where the search ended)."""
        wrap = (1 << self._bits) - 1
        slot = ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self._bits)).astype(np.int64)
        held = self._keys[slot]
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & wrap
            held = self._keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held != 0)]
        return np.where(self._keys[slot] == keys, self._entry[slot], -1), slot

    def add(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Distinct new chunks with the number of their ids and all ids in turn;
        there must be room."""
        n = len(hashes)
        self._start = _grown(self._start, self._count + n)
        self._size = _grown(self._size, self._count + n)
        self._ids = _grown(self._ids, self._used + len(flat))
        self._start[self._count:self._count + n] = self._used + np.cumsum(sizes) - sizes
        self._size[self._count:self._count + n] = sizes
        self._ids[self._used:self._used + len(flat)] = flat
        numbers = np.arange(self._count, self._count + n, dtype=np.int32)
        self._count += n
        self._used += len(flat)
        keys = hashes | U(1)
        while len(keys):
            _, slot = self._find(keys)
            self._keys[slot] = keys
            placed = self._keys[slot] == keys
            self._entry[slot[placed]] = numbers[placed]
            keys, numbers = keys[~placed], numbers[~placed]

    def look_up(self, hashes: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in turn, end of each). ``learn`` gets the positions
        of one chunk of each unknown hash and returns (sizes, ids in turn)."""
        keys = hashes | U(1)
        entries, _ = self._find(keys)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new, sample = np.unique(keys[missing], return_index=True)
            if self._count + len(new) > self._most:
                self._bits = max(self._bits, int(2 * len(keys)).bit_length())
                self._clear()
                new, sample = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            self.add(new, *learn(missing[sample]))
            entries[missing], _ = self._find(keys[missing])
        return self.gather(entries)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries one after the other, end of each)."""
        sizes = self._size[entries]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(self._start[entries] - ends + sizes, sizes) + np.arange(total)], ends


def _grown(array: np.ndarray, need: int) -> np.ndarray:
    if need <= len(array):
        return array
    out = np.zeros(max(need, 2 * len(array)), array.dtype)
    out[:len(array)] = array
    return out
