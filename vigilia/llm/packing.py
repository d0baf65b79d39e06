"""Packing tokenized documents into sequences of fixed length.

Whole windows of a long document become sequences of their own; its last piece
joins a group of such pieces. A group is spread over windows by Karmarkar-Karp
multiway differencing: partial partitions with the largest imbalance are merged
with opposing order, the heaviest windows of one on the lightest of the other.
Documents may be cut, so what exceeds a window's capacity is cut off and fills
the gaps of others; where cuts are not wanted the window count rises instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vigilia.llm import arrays
from vigilia.llm.memory import Remembered

CAPACITY = 1024
#: Last pieces packed together; an upper bound of a group, not of the data.
GROUP = 512
_SPECIAL = "<|endoftext|>"
# First two UTF-8 bytes of white space beyond ASCII.
_WIDE = [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]
#: Chunks a worker remembers.
_REMEMBER = 1_000_000


class Encoder:
    """Byte-level BPE ids as little-endian uint32 bytes.

    The vocabulary's pattern never joins what stands before a single space to
    what follows, unless white space stands on both sides. Other texts are
    encoded chunk by chunk, a distinct chunk once as long as it is remembered.
    """

    def __init__(self, path: str):
        import json
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        points = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(points)]
        back = {chr(p): p for p in points} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t != _SPECIAL}
        ranks = {bytes(back[c] for c in t): i for t, i in vocabulary.items()}
        import public_tokenizers
        self._special = next(t["id"] for t in spec["added_tokens"] if t["content"] == _SPECIAL)
        self._core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})
        self._size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._size[i] = len(token)
        self._chunks = Remembered(_REMEMBER)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._core.encode_ordinary(text), "<u4")

    def _by_itself(self, text: str) -> bytes:
        special = np.array([self._special], "<u4").tobytes()
        return special.join(self._whole(p).tobytes() for p in text.split(_SPECIAL))

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Little-endian uint32 ids of every text of a string column."""
        data, offsets = arrays.utf8(texts)
        spaces = np.flatnonzero(data == 32)
        texts_of = np.searchsorted(offsets, spaces, "right") - 1
        special = {int(i): self._by_itself(texts[int(i)].as_py()) for i in self._odd(data, offsets, spaces, texts_of)}
        # Chunks: from a text's start or a space to the next; a line feed between words is its own.
        lines = np.flatnonzero(data[1:-1] == 10) + 1
        lines = lines[~arrays.SPACE[data[lines - 1]] & ~arrays.SPACE[data[lines + 1]]]
        edge = np.zeros(len(data) + 1, dtype=bool)
        for at in (spaces, lines, lines + 1, offsets[:-1]):
            edge[at] = True
        edges = np.flatnonzero(edge[:-1])
        starts, ends = arrays.without_marks(data, edges, np.append(edges[1:], len(data))[:len(edges)])
        first = np.searchsorted(starts, offsets)
        hashes = arrays.word_hashes(data, starts, ends)
        return arrays.spliced(*self._chunks.look_up(
            hashes, lambda some: self._learn(data, starts[some], ends[some])), first, special)

    def _learn(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids in turn) of chunks, most of them from one text:
        chunks without white space but for a first space, the others each after a
        line feed, are cut there as they are alone."""
        raw = data.tobytes()
        spaced = data[starts] == 32
        inner = np.concatenate(([0], np.cumsum(arrays.SPACE[data])))
        plain = (inner[ends] - inner[starts] == spaced) & (ends - starts > spaced)
        pieces, sizes = [], np.zeros(len(starts), np.int64)
        for a, b, s in zip(starts[plain].tolist(), ends[plain].tolist(), spaced[plain].tolist()):
            pieces.append(raw[a:b] if s else b"\n" + raw[a:b])
        ids = self._whole(b"".join(pieces).decode())
        # Byte ends of the pieces, and of the line feeds before them, are ends of tokens.
        ends_of = np.cumsum([len(p) for p in pieces]).astype(np.int64)
        reached = np.cumsum(self._size[ids])
        stop = np.searchsorted(reached, ends_of, "right")
        begin = np.concatenate(([0], stop[:-1])) + ~spaced[plain] if len(stop) else stop
        sizes[plain] = stop - begin
        rest = {int(i): self._whole(raw[starts[i]:ends[i]].decode()) for i in np.flatnonzero(~plain)}
        keep = np.ones(len(ids), dtype=bool)
        keep[(begin - 1)[~spaced[plain]]] = False
        flat = ids[keep]
        if rest:
            for i, got in rest.items():
                sizes[i] = len(got)
            out = np.zeros(sizes.sum(), "<u4")
            place = np.repeat(plain, sizes)
            out[place] = flat
            out[~place] = np.concatenate(list(rest.values()))
            flat = out
        return sizes, flat

    @staticmethod
    def _odd(data, offsets, spaces, texts_of) -> np.ndarray:
        """Texts not to be cut at spaces: with a space between white space (or
        before the end), with white space beyond ASCII, or with ``<|``."""
        if not len(data):
            return spaces
        after = np.minimum(spaces + 1, len(data) - 1)
        last = spaces + 1 >= offsets[texts_of + 1]
        start = spaces == offsets[texts_of]
        risky = texts_of[~start & arrays.SPACE[data[np.maximum(spaces - 1, 0)]] & (last | arrays.SPACE[data[after]])]
        pairs = data[:-1].astype(np.int32) << 8 | data[1:]
        wide = np.flatnonzero(np.isin(pairs, _WIDE) | (pairs == 0x3C7C))
        return np.unique(np.concatenate((risky, np.searchsorted(offsets, wide, "right") - 1)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Items spread over ``windows`` windows by Karmarkar-Karp: lists of item
    numbers, the sums as near to one another as the method gets."""
    heap: list[tuple[int, int]] = []
    sums, sides = [], []
    for i, n in enumerate(lengths):
        sums.append(np.append(np.zeros(windows - 1, np.int64), n))
        sides.append([()] * (windows - 1) + [(i,)])
        heap.append((-n, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        joined = [x + y if x and y else x or y for x, y in zip(sides[a], reversed(sides[b]))]
        order = np.argsort(total, kind="stable")
        total = total[order]
        sums[a], sides[a] = total - total[0], [joined[k] for k in order]
        sums[b] = sides[b] = None
        heapq.heappush(heap, (-int(sums[a][-1]), a))
    return [list(s) for s in sides[heap[0][1]]] if heap else []


def whole_windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows that hold uncut items of at most ``capacity``: as many as needed
    by the total, and one more for as long as a window exceeds its capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        made = differencing(lengths, windows)
        if all(sum(lengths[i] for i in w) <= capacity for w in made):
            return made
        windows += 1


def cut_windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length), all full but for the last ones,
    whose lengths are falling powers of two, so that nothing is padded."""
    windows = -(-sum(lengths) // capacity)
    if not windows:
        return []
    spread = sorted(differencing(lengths, windows), key=lambda w: -sum(lengths[i] for i in w))
    made, over = [], []
    for window in spread:
        room, pieces = capacity, []
        for i in window:
            take = min(room, lengths[i])
            if take:
                pieces.append((i, 0, take))
            if take < lengths[i]:
                over.append((i, take, lengths[i] - take))
            room -= take
        made.append((room, pieces))
    # Gaps take what was cut off; if the total leaves some gap, the last window keeps it.
    tail = made.pop()[1]
    over = tail + over
    out = []
    for room, pieces in made:
        while room:
            i, start, n = over.pop()
            take = min(room, n)
            pieces.append((i, start, take))
            if take < n:
                over.append((i, start + take, n - take))
            room -= take
        out.append(pieces)
    left = sum(n for _, _, n in over)
    while left:
        size = 1 << (left.bit_length() - 1)
        room, pieces = size, []
        while room:
            i, start, n = over.pop()
            take = min(room, n)
            pieces.append((i, start, take))
            if take < n:
                over.append((i, start + take, n - take))
            room -= take
        out.append(pieces)
        left -= size
    return out


SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: its document, place there, sequence, place there, and the
    ids (little-endian uint32). Every id of every document is in one piece.

    A document is its ids and ``end_id``; null and empty texts have that one id.
    Rows with a null or repeated id are documents of their own. Each task packs
    the rows it reads: no shuffle, and a group of at most ``GROUP`` pieces in
    memory. A sequence's id is its task's number and a count, so a task that is
    run again gives the same ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_batch
        end = np.array([end_id], "<u4").tobytes()
        task, count = TaskContext.get().partitionId() << 40, 0
        rows, waiting = [], []

        def flush():
            nonlocal count
            for window in cut_windows([len(w[2]) // 4 for w in waiting], capacity):
                offset = 0
                for i, start, n in window:
                    doc, before, ids, total = waiting[i]
                    rows.append((doc, before + start, n, total, task + count, offset, ids[4 * start:4 * (start + n)]))
                    offset += n
                count += 1
            waiting.clear()

        def batch_of(rows):
            columns = zip(*rows)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def encoded():
            for whole in batches:
                for batch in arrays.slices(whole):
                    yield from zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")))

        for doc, ids in encoded():
            ids += end
            total = len(ids) // 4
            full = total - total % capacity
            for start in range(0, full, capacity):
                rows.append((doc, start, capacity, total, task + count, 0, ids[4 * start:4 * (start + capacity)]))
                count += 1
            if full < total:
                waiting.append((doc, full, ids[4 * full:], total))
            if len(waiting) == GROUP:
                flush()
            if len(rows) > 4_000:
                yield batch_of(rows)
                rows.clear()
        flush()
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
