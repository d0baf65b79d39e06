"""Byte pair encoding by a tokenization automaton.

The automaton reads token sequences: its states are the tokens, and an arc t
leads from state p to state t unless p, t can not stand side by side in any
encoding. It starts as the universal automaton over the base symbols and takes
one gadget per merge (u, v) -> w, in order: the state u loses its arc v, the new
state w takes a copy of what v may be followed by, and every state with an arc u
gets an arc w (for u = v, the state u does not, as merges run from the left).
Copies are kept as pointers to the copied state and its time, not written out:
a missing arc is found by following them. That keeps the compiled automaton at
a few tables the size of the vocabulary.

A word's encoding is the one path whose arc labels spell it. Prefixes have one
path each as well, so the table "last token of every prefix" is filled from left
to right by table look-ups: the tokens ending here come from a trie, and the one
kept is that which the automaton allows after the last token before it. All
words of a batch move through the tables together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigilia.llm import arrays
from vigilia.llm.arrays import U
from vigilia.llm.memory import Remembered

#: Chunks a worker remembers; words as well.
_REMEMBER = 250_000
_START = -1
_MARK = "</w>"


class Table:
    """uint64 keys to int32 values by open addressing; look-ups of whole arrays."""

    _EMPTY = U(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift, self._wrap = U(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, self._EMPTY)
        self._values = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self._keys[at] == self._EMPTY
            self._keys[at[free]] = keys[todo[free]]
            placed = self._keys[at] == keys[todo]
            self._values[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self._wrap

    def _slot(self, keys):
        return ((keys * U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self._keys[at]
        out = np.where(held == keys, self._values[at], -1)
        todo = np.flatnonzero((held != keys) & (held != self._EMPTY))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self._wrap
            held = self._keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self._values[at[hit]]
            on = ~hit & (held != self._EMPTY)
            todo, at = todo[on], at[on]
        return out


def _bytes_of() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled merges of a vocabulary whose words end in a marked symbol."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        back = _bytes_of()
        size = max(vocabulary.values()) + 1
        self.labels = [""] * size
        self._time = np.full(size, -1, np.int64)
        self._left, self._right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pairs, times = [], []
        for time, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self._time[w], self._left[w], self._right[w] = time, u, v
            pairs.append(u << 32 | v)
            times.append(time)
        self._pairs = Table(np.array(pairs, U), np.array(times, np.int32))
        keys, nodes, tokens, depth = [], {}, [-1], 0
        for text, token in vocabulary.items():
            self.labels[token] = text
            ended = text.endswith(_MARK)
            body = text[:-len(_MARK)] if ended else text
            if not body or any(c not in back for c in body):
                continue  # a special token
            symbols = [back[c] for c in body]
            symbols[-1] += 256 * ended
            node = 0
            for s in symbols:
                key = node << 16 | s
                if key not in nodes:
                    nodes[key] = len(tokens)
                    keys.append(key)
                    tokens.append(-1)
                node = nodes[key]
            tokens[node] = token
            depth = max(depth, len(symbols))
        self._trie = Table(np.array(keys, U), np.arange(1, len(tokens), dtype=np.int32))
        self._token, self._depth = np.array(tokens, np.int64), depth

    def allows(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether state p has an arc t, for arrays of both."""
        out = np.ones(len(p), dtype=bool)
        live = np.flatnonzero(p != _START)
        p, t = p[live], t[live]
        now = np.full(len(p), np.iinfo(np.int64).max)  # arcs are asked for as of this time
        while len(live):
            lost = self._pairs.get(p.astype(U) << U(32) | t.astype(U))
            tp, tt = self._time[p], self._time[t]
            doubled = (self._left[t] == p) & (self._right[t] == p) & (tt < now)
            gone = ((lost >= 0) & (lost < now)) | doubled
            out[live[gone]] = False
            on = ~gone & (np.maximum(tp, tt) >= 0)
            live, p, t, tp, tt = live[on], p[on], t[on], tp[on], tt[on]
            newer = tp >= tt  # p's row was copied from its right part, else t's column from its left
            now = np.where(newer, tp, tt)
            p, t = np.where(newer, self._right[p], p), np.where(newer, t, self._left[t])
        return out

    def _same_length(self, symbols: np.ndarray) -> list[bytes]:
        n, length = symbols.shape
        last = np.full((n, length + 1), _START, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        found = np.zeros((n, length + 1), dtype=bool)
        # ends[j][k]: the token from j over k + 1 symbols, -1 if none; filled as a trie walk per start.
        walks = []
        for j in range(length):
            node = np.zeros(n, np.int64)
            alive = np.arange(n)
            walk = []
            for k in range(j, min(length, j + self._depth)):
                step = self._trie.get(node[alive].astype(U) << U(16) | symbols[alive, k].astype(U))
                alive, step = alive[step > 0], step[step > 0]
                if not len(alive):
                    break
                node[alive] = step
                token = self._token[step]
                walk.append((alive[token >= 0], token[token >= 0]))
            walks.append(walk)
        for i in range(1, length + 1):
            for j in range(max(0, i - self._depth), i):
                if i - j > len(walks[j]):
                    continue
                rows, token = walks[j][i - j - 1]
                open_ = ~found[rows, i]
                rows, token = rows[open_], token[open_]
                if len(rows):
                    fine = self.allows(last[rows, j], token)
                    rows, token = rows[fine], token[fine]
                    last[rows, i], back[rows, i], found[rows, i] = token, j, True
        out = np.zeros((n, length), "<u4")
        at, fill = np.full(n, length), np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            fill[rows] -= 1
            out[rows, fill[rows]] = last[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return [out[i, fill[i]:].tobytes() for i in range(n)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of every word."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for length, members in groups.items():
            step = max(1, 400_000 // (length * length))
            for a in range(0, len(members), step) if length else ():
                some = members[a:a + step]
                symbols = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(-1, length).astype(np.int64)
                symbols[:, -1] += 256
                for i, ids in zip(some, self._same_length(symbols)):
                    out[i] = ids
        return out

    def decode(self, ids: bytes) -> str:
        return spelled(self.labels, ids)


def spelled(labels: list[str], ids: bytes) -> str:
    """The labels of the arcs taken, joined as the vocabulary's decoder does."""
    return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def arc_labels(path: str) -> list[str]:
    """The arc label of every id: all that decoding needs of the automaton."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [""] * (max(known.values()) + 1)
    for text, i in known.items():
        labels[i] = text
    return labels


class WordBPE:
    """A tokenizer file of the word-end kind: NFC, lower case, white space only
    separates. Its special tokens are found in the raw text.

    Texts are cut at white space; chunks met lately are remembered by their hash.
    Chunks that are not ASCII are normalised and split by the file's own rules.
    """

    # Fixed value: the vocabulary's own split pattern, for ASCII.
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.automaton = Automaton(spec["model"]["vocab"], spec["model"]["merges"])
        self._special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        labels = self.automaton.labels
        labels += [""] * (max((t["id"] for t in spec["added_tokens"]), default=-1) + 1 - len(labels))
        for t in spec["added_tokens"]:
            labels[t["id"]] = t["content"]
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")")
        whole = Tokenizer.from_file(path)
        self._normal, self._pre = whole.normalizer, whole.pre_tokenizer
        self._back = _bytes_of()
        self._chunks, self._words = Remembered(_REMEMBER), {}  # of chunks and of their words

    def _split(self, chunk: bytes) -> list[bytes]:
        if chunk.isascii():
            return [w.encode() for w in self._SPLIT.findall(chunk.decode().lower())]
        back = self._back
        return [bytes([back[c] for c in w])
                for w, _ in self._pre.pre_tokenize_str(self._normal.normalize_str(chunk.decode()))]

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        pieces = [self._split(c) for c in chunks]
        if len(self._words) > _REMEMBER:
            self._words.clear()
        ids = self._words
        words = list({w for p in pieces for w in p if w not in ids})
        ids.update(zip(words, self.automaton.encode_words(words)))
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in pieces]

    def _with_special(self, text: str) -> bytes:
        """A text in which a special token may stand."""
        return b"".join(self._special.get(p) or b"".join(self._encode_chunks(p.encode().split()))
                        for p in self._cut.split(text) if p)

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Little-endian uint32 ids of every text of a string column."""
        data, offsets = arrays.utf8(texts)
        marked = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
        special = {int(i): self._with_special(texts[int(i)].as_py())
                   for i in np.unique(np.searchsorted(offsets, marked, "right") - 1)}
        starts, ends, _ = arrays.words(data, offsets)
        starts, ends = arrays.without_marks(data, starts, ends)
        first = np.searchsorted(starts, offsets)
        high = np.concatenate(([0], np.cumsum(data >= 128)))
        plain = high[ends] == high[starts]
        hashes = arrays.word_hashes(arrays.LOWER[data], starts, ends)
        hashes[~plain] = arrays.word_hashes(data, starts[~plain], ends[~plain]) ^ U(0x5555)
        raw = data.tobytes()

        def learn(some):
            chunks = self._encode_chunks([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            return np.fromiter((len(c) // 4 for c in chunks), np.int64, len(chunks)), np.frombuffer(b"".join(chunks), "<u4")

        return arrays.spliced(*self._chunks.look_up(hashes, learn), first, special)


_LOADED: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian uint32 binary, for every row in place.

    Null and empty texts have no ids. One pass without a shuffle; a worker keeps
    the tables and a bounded memory of chunks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_bpe(tokenizer_path)
        for whole in batches:
            for batch in arrays.slices(whole):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(tokenizer.encode_batch(batch.column("text")), pa.binary())],
                    ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) from (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [spelled(labels, i) for i in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded string")
