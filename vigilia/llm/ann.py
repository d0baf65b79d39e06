"""Nearest neighbours by collision counting on single projections.

Each vector is projected on ``PROJECTIONS`` random lines; along a line the
vectors are a sorted array. A query opens a window around its own projection on
every line and counts the windows a vector falls into. Windows grow by virtual
rehashing: a larger radius reads further along the same arrays. A vector that
has collided often enough for its radius is verified by its true distance, and a
query is done when it has its k nearest within the radius reached.

Rows are dealt evenly into numbered blocks of about ``BLOCK`` rows; each block is
indexed by itself and searched for blocks of queries, so no task holds more than
one of each, and only k rows a query and block go on. The queries, the smaller
side, are repeated for every block; the vectors are moved twice in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS = 96
GROWTH = 1.08
#: Standard deviations by which the threshold lies below the collisions expected at the radius.
SLACK = 1.0
#: The first radius, as a share of the distance to the nearest of about ``PROBES``
#: vectors spread over the block: windows narrower than that would be opened in vain.
START, PROBES = 0.3, 256
#: Vectors of a block, about, and queries of a block.
BLOCK, QUERIES = 16_384, 1_024
_SEED = 20240229


class Index:
    """The sorted projections of one block of vectors.

    All lines lie behind one another in one array, each moved by a multiple of
    the widest one, so that one search finds the ends of all windows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lines = np.random.default_rng(_SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        placed = vectors @ self.lines
        order = np.argsort(placed, axis=0, kind="stable")
        self._reach = float(np.abs(placed).max()) * 1.01 + 1e-300
        self._moved = 4 * self._reach * np.arange(PROJECTIONS)
        self._sorted = (np.take_along_axis(placed, order, axis=0) + self._moved).T.ravel()
        self._order = order.T.ravel()
        self._first = np.arange(PROJECTIONS) * len(ids)
        # The first window holds about one in fifty vectors of a middling line.
        width = np.quantile(placed, 0.51, axis=0) - np.quantile(placed, 0.49, axis=0)
        self._radius = max(float(np.median(width)), self._reach * 1e-6)
        self._distinct = len(np.unique(ids))
        self.verified = 0
        self._probes = vectors[:: max(1, len(ids) // PROBES)]

    def _ends(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self._sorted, np.clip(at, -self._reach, self._reach) + self._moved, side)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest found, (distance, id), without vectors of the query's id.
        ``verified`` counts the vectors whose true distance was taken."""
        n = len(self.ids)
        own = self.ids == query_id
        want = min(k, self._distinct - bool(own.any()))
        if want <= 0:
            return []
        centre = query @ self.lines
        counts = np.zeros(n, np.int64)
        distance = np.where(own, np.inf, np.nan)
        low = self._ends(centre, "left")
        high = low.copy()
        probed = np.sqrt(((self._probes - query) ** 2).sum(axis=1))
        radius = max(self._radius, START * probed[probed > 0].min(initial=np.inf) if probed.any() else 0.0)
        chance = 0.6826894921370859  # that a normal value is within one standard deviation
        threshold = chance * PROJECTIONS - SLACK * np.sqrt(chance * (1 - chance) * PROJECTIONS)
        while True:
            a = np.minimum(self._ends(centre - radius, "left"), low)
            b = np.maximum(self._ends(centre + radius, "right"), high)
            starts, sizes = np.concatenate((a, high)), np.concatenate((low - a, b - high))
            at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            counts += np.bincount(self._order[at], minlength=n)
            low, high = a, b
            new = np.flatnonzero((counts >= threshold) & np.isnan(distance))
            distance[new] = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
            within = self.ids[distance <= radius]
            if len(within) >= want and len(np.unique(within)) >= want or (counts >= PROJECTIONS).all():
                break
            radius *= GROWTH
        known = np.flatnonzero(np.isfinite(distance))
        self.verified += len(known)
        best = known[np.lexsort((self.ids[known], distance[known]))]
        ids, at = np.unique(self.ids[best], return_index=True)
        return [(float(distance[best[i]]), int(self.ids[best[i]])) for i in np.sort(at)[:k]]


def _pack(size: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition as (block, width, ids, vectors), binary, a row for each
        length of vectors: with the partition's number, or by ``size``."""
        held: dict[int, tuple[list, list]] = {}
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()

        def blocks():
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * len(held), pa.int64()), pa.array(list(held), pa.int64()),
                 pa.array([np.concatenate(i).tobytes() for i, _ in held.values()], pa.binary()),
                 pa.array([np.concatenate(v).tobytes() for _, v in held.values()], pa.binary())],
                ["block", "width", "ids", "vectors"])

        for batch in batches:
            for start in range(0, batch.num_rows, size or max(1, batch.num_rows)):
                part = batch.slice(start, size)
                widths = pc.list_value_length(part.column("embedding"))
                for width in pc.unique(widths).to_pylist():
                    some = part.filter(pc.equal(widths, width))
                    ids, vectors = held.setdefault(width, ([], []))
                    ids.append(some.column("vec_id").to_numpy().astype(np.int64))
                    vectors.append(some.column("embedding").flatten().to_numpy().astype(np.float64))
                if size:
                    yield blocks()
                    held.clear()
        if held:
            yield blocks()
    return run


_BLOCK = "block bigint, width bigint, ids binary, vectors binary"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if (row["block"], row["width"]) != held:
                    ids = np.frombuffer(row["ids"], np.int64)
                    held, index = (row["block"], row["width"]), Index(ids, np.frombuffer(row["vectors"]).reshape(len(ids), -1))
                queries = np.frombuffer(row["query_ids"], np.int64)
                points = np.frombuffer(row["query_vectors"]).reshape(len(queries), -1)
                out = [(int(q), d, i) for q, p in zip(queries, points) for d, i in index.search(int(q), p, k)]
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()),
                                                      pa.array(b, pa.float64())], ["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, empty, zero or holding a null
    or a value that is not finite. Vectors meet those of their own length."""
    v = F.col("embedding").cast("array<double>")
    limit = F.lit(float("inf"))
    return (vectors.select("vec_id", v.alias("embedding"))
            .where("vec_id is not null and embedding is not null")
            .where(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False)))
                   & F.exists("embedding", lambda x: x != 0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query.

    ``vectors`` and ``queries`` have vec_id and embedding as `usable` gives them.
    A query's candidates are all rows of another id and its own vector's length, all
    of them if fewer than k; equal distances go by the smaller id; a repeated row
    counts once. An id with several vectors asks with each, and is found by its nearest.
    """
    count = -(-vectors.count() // BLOCK)
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks = vectors.repartition(count).mapInArrow(_pack(None), _BLOCK)
    asked = (queries.dropDuplicates(["vec_id", "embedding"]).mapInArrow(_pack(QUERIES), _BLOCK)
             .select(F.explode(F.sequence(*(F.lit(x).cast("bigint") for x in (0, count - 1)))).alias("block"),
                     "width", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")))
    # A stated number of partitions: blocks are few bytes and much work, so sizes must not merge them.
    found = (blocks.repartition(2 * count, "block").join(asked.repartition(2 * count, "block"), ["block", "width"])
             .sortWithinPartitions("block", "width")
             .select("block", "width", "ids", "vectors", "query_ids", "query_vectors")
             .mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (found.withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
