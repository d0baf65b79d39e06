"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios, trained on labelled text.

Presence of an n-gram counts, not its number. For each n-gram the ratio
r = log of its smoothed share among toxic texts over that among the others; a
logistic model is fitted on features worth r each, over the n-grams whose ratio
is furthest from chance. Counts are made by Spark over a bounded labelled
sample; only the chosen n-grams and their few features a text reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigilia.llm.arrays import U, mix
from vigilia.llm.tables import stored, text_key

#: Labelled texts of each class used for fitting: the bound of the training sample.
SAMPLE = 3_000
SIZES = (4, 5, 6)
BITS = 22
#: N-grams kept, by the strength of their ratio.
FEATURES = 4_096
#: Texts that must hold an n-gram before it is considered.
LEAST = 5
_SMOOTH = 1.0
#: Places that hashes of ids are dealt to when the sample is drawn.
_PLACES = 1 << 30


class Model(NamedTuple):
    """``slot`` maps an n-gram's hash to a feature (0: none); ``weight`` is the
    product of fitted weight and ratio for each feature."""
    slot: np.ndarray
    weight: np.ndarray
    bias: float


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every n-gram of every text; lower case, white space
    as one space, a space before and after each text."""
    folded = [f" {' '.join((t or '').lower().split())} " for t in texts]
    lengths = np.array([len(t) for t in folded], dtype=np.int64)
    points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    hashes, owners = [], []
    rolled = points * U(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * U(0xD6E8FEB86659FD93) + points[n - 1:]
        if n in SIZES and len(rolled):
            whole = owner[:len(rolled)] == owner[n - 1:]
            hashes.append((mix(rolled[whole] + U(n)) >> U(64 - BITS)).astype(np.int32))
            owners.append(owner[:len(rolled)][whole])
    if not hashes:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _pieces(texts: list, limit: int = 300_000) -> Iterator[tuple[int, list]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def _chosen(texts: list, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs."""
    h, owner = ngrams(texts)
    feature = slot[h].astype(np.int64)
    hit = np.flatnonzero(feature)
    pairs = np.unique(owner[hit] * (FEATURES + 1) + feature[hit])
    return pairs // (FEATURES + 1), pairs % (FEATURES + 1)


def _lowest(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each class, the lowest by a hash of ``keys``.

    Hashes are even, so about ``2 * most`` rows of a class lie below the share of
    the hashes that would hold as many; only those are ordered.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(_PLACES))
    sizes = rows.groupBy("toxic").agg(F.count("*").alias("_rows"))
    near = (rows.join(sizes, "toxic").withColumn("_at", place)
            .where(F.col("_at") < F.lit(2.0 * most * _PLACES) / F.col("_rows")))
    order = Window.partitionBy("toxic").orderBy("_at", *keys)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select(*keys, "toxic")


def sample(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` texts of each class: (doc_id, version, text, toxic).

    At most as many ids are drawn from the labels; of their texts, one unless ids
    repeat, as many are drawn again. An id labelled twice is toxic if one label is.
    """
    clean = labelled.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = _lowest(stored(clean, "labels"), ["doc_id"], most)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("version", text_key())
    texts = stored(texts, "sample")
    picked = _lowest(texts.select("doc_id", "version", "toxic").distinct(), ["doc_id", "version"], most)
    return (texts.join(F.broadcast(picked.drop("toxic")), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
            .select("doc_id", "version", "text", "toxic"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for start, texts in _pieces(batch.column("text").to_pylist()):
            h, owner = ngrams(texts)
            pairs = np.unique(owner << BITS | h)
            np.add.at(counts, (toxic[start + (pairs >> BITS)], pairs & ((1 << BITS) - 1)), 1)
    seen = np.flatnonzero(counts.sum(axis=0))
    if len(seen):
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *(pa.array(c[seen].astype(np.int64)) for c in counts)], ["gram", "n0", "n1"])


def _fit(index: np.ndarray, owner: np.ndarray, y: np.ndarray, ratio: np.ndarray,
         rounds: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic weights on features worth ``ratio`` by Adam, classes weighing alike."""
    n, k = len(y), len(ratio)
    weight, bias = np.zeros(k), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m = np.zeros(k + 1)
    v = np.zeros(k + 1)
    value = ratio[index]
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weight[index] * value, n) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(index, error[owner] * value, k) + ridge * weight, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight * ratio, bias


def train(docs: DataFrame, labelled: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    The sample's ids, at most 2 * SAMPLE, are broadcast, so only their texts move.
    Labels that are null or neither 0 nor 1 are left out. Without a labelled text
    of each class every score is 0.5.
    """
    texts = stored(sample(docs, labelled).select("doc_id", "text", "toxic"), "sample")
    slot = np.zeros(1 << BITS, dtype=np.int16)
    totals = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return Model(slot, np.zeros(FEATURES + 1), 0.0)
    counts = texts.mapInArrow(_count, "gram int, n0 bigint, n1 bigint").groupBy("gram").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = [(F.col(f"n{c}") + _SMOOTH) / (totals[c] + 2 * _SMOOTH) for c in (0, 1)]
    ratio = F.log(share[1] / share[0])
    # Strength: the ratio against its standard error, the shares' spread included.
    strength = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + _SMOOTH) + 1 / (F.col("n0") + _SMOOTH))
    best = (counts.where(F.col("n0") + F.col("n1") >= LEAST)
            .select("gram", ratio.alias("ratio"), strength.alias("strength"))
            .orderBy(F.desc("strength"), "gram").limit(FEATURES).collect())
    if not best:
        return Model(slot, np.zeros(FEATURES + 1), 0.0)
    slot[[r.gram for r in best]] = np.arange(1, len(best) + 1)
    ratios = np.concatenate(([0.0], [r.ratio for r in best]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic")
            for start, part in _pieces(texts):
                owner, feature = _chosen(part, slot)
                first = np.searchsorted(owner, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(part)), toxic.slice(start, len(part)).cast(pa.int32()),
                     pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:])], pa.binary())],
                    ["doc_id", "toxic", "features"])

    rows = texts.mapInArrow(features, "doc_id bigint, toxic int, features binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.features)))  # the order of a sum must not vary
    parts = [np.frombuffer(r.features, "<i4").astype(np.int64) for r in rows]
    index = np.concatenate(parts)
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    weight, bias = _fit(index, owner, np.array([r.toxic for r in rows], dtype=float), ratios)
    return Model(slot, np.concatenate((weight, np.zeros(FEATURES + 1 - len(weight)))), float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a last column ``score`` in [0, 1], from the text
    alone; null and empty texts get the score of no n-grams; a column of that name
    is replaced. No shuffle."""
    docs = docs.drop("score")
    slots = np.flatnonzero(model.slot)
    features, weight, bias = model.slot[slots], model.weight, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.zeros(1 << BITS, dtype=np.int16)
        slot[slots] = features
        for batch in batches:
            out = np.empty(batch.num_rows)
            for start, part in _pieces(batch.column("text").to_pylist()):
                owner, feature = _chosen(part, slot)
                z = np.bincount(owner, weight[feature], len(part)) + bias
                out[start:start + len(part)] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))


def held_out(doc_id):
    """Ids whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(False))
