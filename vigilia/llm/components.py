"""Connected components of an edge table, in rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilia.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id reachable.

    Large-star and small-star rounds: every id hangs its larger neighbours, and
    then itself with its smaller ones, below its smallest neighbour, until every
    edge points to its component's smallest id. Rounds grow with the logarithm of
    the longest path; each is two aggregations by id whose minima combine before
    the shuffle, and each result is a table in the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(pairs.distinct(), "edges")
    size, total = -1, -1
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: larger neighbours b of a join a's least id.
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        # Small star: smaller neighbours of a, and a, join the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        current = stored(small, "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (now[0], now[1]) == (size, total):
            break
        size, total = now
    tops = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
