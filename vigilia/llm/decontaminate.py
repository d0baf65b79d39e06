"""Benchmark passages in training texts, by an FM-index of each shard.

Words are lower-cased runs of letters, digits and all code points from U+0080. A
phrase is a window of ``WIDTH`` consecutive words of an item, or all its words if
it has fewer. Each task cuts its documents into shards of bounded size and builds
an FM-index of a shard's words: words that no phrase holds end a stretch. All
phrases are searched backwards together by wavelet-tree ranks, occurrences are
located from sampled suffix positions, and the spans they cover are merged.

Phrases reach the tasks in blocks of a bounded number of rows, whatever the size
of the benchmark; documents pass through the blocks one after the other, without
a shuffle. Words meet by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilia.llm import arrays
from vigilia.llm.arrays import U
from vigilia.llm.fmindex import Index
from vigilia.llm.tables import stored

WIDTH = 10
#: Phrases searched at a time, about 100 bytes each; and bytes of text in a shard.
BLOCK = 200_000
SHARD = 6_000_000
# What is between words, of the lower-cased bytes.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.utf8(batch.column("text"))
    data = arrays.LOWER[data]
    starts, ends, first = arrays.words(data, offsets, _BETWEEN)
    return arrays.word_hashes(data, starts, ends), first


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole):
                h, first = _hashed(batch)
                count = np.diff(first)
                size = np.minimum(count, width)
                each = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
                owner = np.repeat(np.arange(len(count)), each)
                start = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                length = size[owner]
                at = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)),
                                                 pa.array(h[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), words], ["item", "words"])
    return run


def phrases(items: DataFrame, width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, int]:
    """((item, words, block), number of blocks): every distinct phrase of each item once."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(
        _windows(width), "item string, words array<bigint>").distinct()
    rows = stored(rows, "phrases")
    blocks = max(1, -(-rows.count() // max(1, block // 2)))  # half full, so that none goes far beyond
    return rows.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks))), blocks


class Phrases:
    """One block: distinct phrases, aligned to the right, and the items of each."""

    def __init__(self, rows: pa.Table, width: int):
        words = rows.column("words").combine_chunks()
        flat = words.flatten().to_numpy().view(U)
        length = words.value_lengths().to_numpy().astype(np.int64)
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        all_ = np.full((len(length), width), -1, np.int64)
        row = np.repeat(np.arange(len(length)), length)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + (width - length)[row]
        all_[row, column] = number
        self.rows, which = np.unique(all_, axis=0, return_inverse=True) if len(all_) else (all_, np.zeros(0, np.int64))
        self.length = (self.rows >= 0).sum(axis=1)
        names = rows.column("item").to_pylist()
        # Items are numbered in their order as strings; one without an id is none.
        self.names = sorted({n for n in names if n is not None})
        code = {n: i for i, n in enumerate(self.names)}
        pairs = np.array([(p, code[n]) for p, n in zip(which.ravel().tolist(), names) if n is not None], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.items, bounds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.item_first, self.item_count = bounds[:-1], np.diff(bounds)


def occurrences(h: np.ndarray, first: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word) of every occurrence of the block's phrases in a shard."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(block.rows):
        return none, none
    place = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    word = np.flatnonzero(block.vocabulary[place] == h)
    if not len(word):
        return none, none
    present = np.bincount(place[word], minlength=len(block.vocabulary)) > 0
    local = np.where(present, np.cumsum(present), 0)
    # A stretch is a run of such words in one text; a 0 stands before each, and at the end.
    text = np.searchsorted(first, word, "right")
    begins = np.ones(len(word), dtype=bool)
    begins[1:] = (word[1:] != word[:-1] + 1) | (text[1:] != text[:-1])
    at = np.arange(len(word)) + np.cumsum(begins)
    symbols = np.zeros(int(at[-1]) + 2, np.int64)
    symbols[at] = local[place[word]]
    back = np.zeros(len(symbols), np.int64)
    back[at] = word
    index = Index(symbols, int(present.sum()))
    known = np.append(local, -1)[block.rows]  # -1 finds the added last entry
    asked = np.flatnonzero((known != 0).all(axis=1))
    low, high = index.search(known[asked])
    count = high - low
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(asked, count), back[index.locate(rows)]


def _found(batch: pa.RecordBatch, block: Phrases, earlier: bool) -> list[pa.Array]:
    h, first = _hashed(batch)
    n = len(first) - 1
    phrase, word = occurrences(h, first, block)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + block.length[phrase], -1)
    text = np.searchsorted(first, word, "right") - 1
    met = np.unique(text * max(1, len(block.rows)) + phrase)
    doc, which = np.divmod(met, max(1, len(block.rows)))
    count = block.item_count[which]
    code = block.items[np.repeat(block.item_first[which] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    named = np.unique(np.repeat(doc, count) * max(1, len(block.names)) + code)
    owner, code = np.divmod(named, max(1, len(block.names)))
    names = [[] for _ in range(n)]
    for o, c in zip(owner.tolist(), code.tolist()):
        names[o].append(block.names[c])
    if earlier:
        for i, (spans, held) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
            for s in spans:
                cover[first[i] + s["start"]] += 1
                cover[first[i] + s["end"]] -= 1
            if held:
                names[i] = sorted({*held, *names[i]})
    hit = np.cumsum(cover[:-1]) > 0
    owner = np.repeat(np.arange(n), np.diff(first))
    edge = np.ones(len(hit), dtype=bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], len(hit))
    held = hit[runs]
    begin, end = runs[held], ends[held]
    doc = owner[begin]
    bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(begin - first[doc]), pa.array(end - first[doc])], ["start", "end"])
    return [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds), inner), pa.array(names, pa.list_(pa.string()))]


def _search(shared, keep: list[str], earlier: bool):
    names = [*keep, "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, limit=SHARD):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *_found(batch, shared.value, earlier)], names)
    return run


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs`` (doc_id, text).

    ``spans`` are the runs of words inside occurrences, numbered from 0, end
    exclusive, none touching another; ``items`` the ids, as sorted strings, of
    items with an occurring window. Null texts have no words and items without
    words no window; words of an item without an id are hit but name no item.
    Repeated rows and ids are each searched; other columns are left out.
    """
    spark = docs.sparkSession
    rows, blocks = phrases(items, width, block)
    out = docs.select("doc_id", "text")
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    for b in range(blocks):
        some = Phrases(rows.where(F.col("block") == b).select("item", "words").toArrow(), width)
        keep = ["doc_id"] if b == blocks - 1 else ["doc_id", "text"]
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(some), keep, b > 0),
                             ", ".join(f"{c} {kinds[c]}" for c in keep) + f", {_FOUND}")
    return out
