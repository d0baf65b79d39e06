"""Phrases of two and three words that stand together more often than by chance.

Words get 64-bit ids by a hash of language and word; that no word shares the id
of a frequent one is checked on the words themselves, and the hash is changed if
one does. N-grams are packed ids, counted in quotient filters (`quotient`): each
task sorts its n-grams into filters, a row for each range of keys, and the filters
of a range are merged across tasks. Keys are permuted first, so ranges are even
whatever phrase or language prevails, and there are as many ranges as the words
counted ask for.

Phrases below ``LEAST`` are none, so n-grams are counted only if their parts may
reach it: pairs whose words, then triples whose pairs, are marked in a bitmap of a
bounded size. A bitmap marks too much and never too little; counts stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilia.llm import arrays
from vigilia.llm.arrays import U, mix
from vigilia.llm.quotient import counted, merged, packed, permute, restore, unpacked
from vigilia.llm.tables import stored

LEAST = 10
TOP = 2_000
#: Share of a phrase's occurrences, in hundredths, that a longer one must have to stand for it.
INSIDE = 50
#: N-grams a task holds before it sends them, and expected in a range of keys.
_HELD, _RANGE = 400_000, 200_000
#: Bits of a bitmap: 16 for each marked key, within these bounds (8 KB to 32 MB).
_BITS = (2**16, 2**28)
#: Words a task remembers to have named.
_NAMED = 1_000_000
# What separates pieces, and what else separates words.
_PIECES = np.zeros(256, dtype=bool)
_PIECES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _PIECES.copy()
_BETWEEN[[0x20, 0x09]] = True


class Words:
    """The words of a batch: ids, places, and whether the next one follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        data, offsets = arrays.utf8(batch.column("text"))
        self._data = arrays.LOWER[data]
        self._starts, self._ends, first = arrays.words(self._data, offsets, _BETWEEN)
        self.counts = np.diff(first)
        langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        self.langs, which = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        self.by_lang = np.bincount(which, self.counts, len(self.langs)).astype(np.int64) if len(which) else np.zeros(len(self.langs), np.int64)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], U)
        self.lang = np.repeat(which, self.counts)
        self.ids = mix(arrays.word_hashes(self._data, self._starts, self._ends, seed) ^ salt[self.lang])
        self.follows = np.zeros(max(len(self.ids) - 1, 0), dtype=bool)
        if len(self.follows):
            ends = np.cumsum(_PIECES[self._data], dtype=np.int32)  # before a word's first byte as with it
            self.follows = ends[self._starts[1:]] == ends[self._ends[:-1] - 1]
            last = first[1:-1] - 1
            self.follows[last[(last >= 0) & (last < len(self.follows))]] = False

    def text(self, i: int) -> str:
        return self._data[self._starts[i]:self._ends[i]].tobytes().decode()


def _ids(seed: int):
    """(kind, id, lang, n): each word's occurrences by id (0), and each language's words (1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole):
                w = Words(batch, seed)
                ids, n = np.unique(w.ids, return_counts=True)
                langs = len(w.langs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([0, 1], np.int8), [len(ids), langs])),
                    pa.array(np.concatenate((ids.view(np.int64), np.zeros(langs, np.int64)))),
                    pa.array([None] * len(ids) + w.langs, pa.string()),
                    pa.array(np.concatenate((n, w.by_lang)))], ["kind", "id", "lang", "n"])
    return run


def _marked(bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
    at = (spot & U(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _spot(lanes: list[np.ndarray]) -> np.ndarray:
    """Where an n-gram is marked: its first permuted lane."""
    return permute(lanes)[0]


def _names(seed: int, marked):
    """(id, lang, word) of marked words, about once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, U)
        for whole in batches:
            for batch in arrays.slices(whole):
                w = Words(batch, seed)
                some = np.flatnonzero(_marked(marked.value, w.ids))
                ids, first = np.unique(w.ids[some], return_index=True)
                new = ~np.isin(ids, known, assume_unique=True)
                ids, first = ids[new], some[first[new]]
                known = np.union1d(known, ids) if len(known) < _NAMED else ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), pa.array([w.langs[x] for x in w.lang[first].tolist()], pa.string()),
                     pa.array([w.text(i) for i in first.tolist()], pa.string())], ["id", "lang", "word"])
    return run


def _filters(order: int, seed: int, shared: int, marked):
    """(range, grams): filters of all n-grams of ``order`` words whose parts are marked."""
    def send(parts) -> pa.RecordBatch:
        lanes, counts = merged(parts)
        top = (lanes[0] >> U(64 - shared)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        ends = np.append(starts[1:], len(top))
        blobs = [packed([x[a:b] for x in lanes], counts[a:b], shared) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(top[starts]), pa.array(blobs, pa.binary())], ["range", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = marked.value, [], 0
        for whole in batches:
            for batch in arrays.slices(whole):
                w = Words(batch, seed)
                if order == 2:
                    good = _marked(bits, w.ids)
                    at = np.flatnonzero(w.follows & good[1:] & good[:-1]) if len(good) else np.zeros(0, np.int64)
                else:
                    at = np.flatnonzero(w.follows)
                    good = np.zeros(len(w.ids) + 1, dtype=bool)
                    good[at] = _marked(bits, _spot([w.ids[at], w.ids[at + 1]]))
                    at = np.flatnonzero(good[1:] & good[:-1])
                if not len(at):
                    continue
                held.append(counted(permute([w.ids[at + i] for i in range(order)])))
                size += len(held[-1][1])
                if size > _HELD:
                    held = [merged(held)]
                    size = len(held[0][1])
                    if size > _HELD // 2:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)
    return run


def _frequent(order: int, shared: int, least: int):
    """Sorted by range: the n-grams of merged filters that reach ``least``."""
    def result(key: int, parts: list) -> pa.RecordBatch:
        lanes, counts = merged(parts)
        some = counts >= least
        lanes = [x[some] for x in lanes]
        spot = lanes[0]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x.view(np.int64)) for x in restore(lanes)), pa.array(spot.view(np.int64)), pa.array(counts[some])],
            [*(f"w{i + 1}" for i in range(order)), "spot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size = None, [], 0
        for batch in batches:
            for now, blob in zip(batch.column("range").to_pylist(), batch.column("grams")):
                if now != key and parts:
                    yield result(key, parts)
                    parts, size = [], 0
                key = now
                parts.append(unpacked(blob.as_buffer(), order, now, shared))
                size += len(parts[-1][1])
                if size > 4 * _RANGE and len(parts) > 1:
                    parts = [merged(parts)]
                    size = 0  # grows again by what is added
        if parts:
            yield result(key, parts)
    return run


def _bitmap(keys: DataFrame, column: str, number: int):
    """A broadcast bitmap of the keys' low bits; its size is bounded by ``_BITS``."""
    bits = min(max(1 << int(16 * max(number, 1)).bit_length(), _BITS[0]), _BITS[1])
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = (keys.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in zip(rows.column("b").to_pylist(), rows.column("m").to_pylist()):
        out[(b - 1) * 4096:(b - 1) * 4096 + 4096] = np.frombuffer(m, np.uint8)[:len(out)]
    return keys.sparkSession.sparkContext.broadcast(out)


def _grams(rows: DataFrame, order: int, shared: int, least: int) -> DataFrame:
    kinds = ", ".join(f"w{i + 1} bigint" for i in range(order))
    # As many partitions as the ranges ask for: a partition's filters do not grow with the table.
    return stored(rows.repartition(max(1, (1 << shared) // 8), "range").sortWithinPartitions("range")
                  .mapInArrow(_frequent(order, shared, least), f"{kinds}, spot bigint, n bigint"), f"grams{order}")


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact counts: languages (lang, n), words (id, lang, word, n), pairs (w1, w2, n)
    and triples (w1, w2, w3, n) that occur ``least`` times, by word ids."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    seed = 0
    while True:
        each = texts.mapInArrow(_ids(seed), "kind tinyint, id bigint, lang string, n bigint")
        each = stored(each.groupBy("kind", "id", "lang").agg(F.sum("n").alias("n"))
                      .where((F.col("n") >= least) | (F.col("kind") == 1)), "words")
        langs = each.where("kind = 1 AND n > 0").select("lang", "n")
        total = langs.agg(F.sum("n")).first()[0] or 0
        frequent = each.where("kind = 0").select("id", "n")
        shared = min(max(int(total // _RANGE).bit_length(), 1), 40)
        marked = _bitmap(frequent, "id", frequent.count())
        word = F.struct("lang", "word")
        named = texts.mapInArrow(_names(seed, marked), "id bigint, lang string, word string").groupBy("id").agg(
            F.min(word).alias("word"), F.max(word).alias("other"))
        named = stored(frequent.join(named, "id"), "named")
        if named.where("word <> other").isEmpty():
            break
        seed += 1  # two words, one of them frequent, share an id: other ids
    words = named.select("id", "word.*", "n")
    grams = "range bigint, grams binary"
    pairs = _grams(texts.mapInArrow(_filters(2, seed, shared, marked), grams), 2, shared, least)
    marked = _bitmap(pairs, "spot", pairs.count())
    triples = _grams(texts.mapInArrow(_filters(3, seed, shared, marked), grams), 3, shared, least)
    return langs, words, pairs.drop("spot"), triples.drop("spot")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)), exactly."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    above = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    below = wide[1] * wide[2]
    # The whole part of an exact quotient: `/` alone would round.
    return ((above - above % below) / below).cast("bigint")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A null language is 'und', a null text empty; repeated rows count each time;
    languages without words have no rows; other columns than text and lang play
    no part.
    """
    langs, words, pairs, triples = counts(docs, least)
    longer = (triples.select("w1", "w2", "n").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
              .groupBy("w1", "w2").agg(F.max("n").alias("most")))
    one = words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("first"), F.col("n").alias("n1"))
    last = lambda c: words.select(F.col("id").alias(c), F.col("word").alias("last"), F.col("n").alias("n2"))
    two = (
        pairs.join(longer, ["w1", "w2"], "left").where(f"most IS NULL OR 100 * most < {inside} * n")
        .join(one, "w1").join(last("w2"), "w2")
        .select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), F.col("n").alias("a"),
                F.col("n1").alias("l"), F.col("n2").alias("r"), _score(F.col("n"), F.col("n1"), F.col("n2")).alias("score")))
    head = pairs.select("w1", "w2", F.col("n").alias("n12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("n23"))
    middle = words.select(F.col("id").alias("w2"), F.col("word").alias("middle"))

    def cut(k: int, left: str, right: str) -> Column:
        return F.struct(_score(F.col("n"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"),
                        F.col(left).alias("l"), F.col(right).alias("r"))

    three = (
        triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(one, "w1").join(middle, "w2").join(last("w3"), "w3")
        .select("lang", F.concat_ws(" ", "first", "middle", "last").alias("phrase"), F.col("n").alias("a"),
                F.least(cut(1, "n1", "n23"), cut(2, "n12", "n2")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language's phrases are cut in parts first, so that one language is no single task's.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = two.unionByName(three).withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
