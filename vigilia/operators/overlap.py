"""Interval overlap per resource without forming pairs.

Counting: the stored intervals overlapping ``[s, e)`` number "starts before e"
minus "ends by s". Both are running counts over one time-ordered union, taken
over ranges of (resource, time) of even size, so a resource holding a third of
all intervals, or one crowded day, is spread over as many tasks as it has ranges.

Lowest key: a minimum cannot be subtracted, so time is cut into dyadic nodes,
(level k, n) being ``[n * 2^k, (n + 1) * 2^k)``. Every interval is a disjoint
union of a few nodes (its cover) and every point lies in one node per level
(its path). A and B overlap when A covers B's start or A starts inside B; both
become equi-joins on (resource, node) against one aggregated row per node.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from vigilia.functions.clock import epoch_micros
from vigilia.operators.ranges import running

_UNITS = (60_000_000, 1_000_000, 1_000, 1)


def _by_level(df: DataFrame, levels: int) -> tuple[DataFrame, Column]:
    """Every row once per level, and the width of its level's nodes."""
    leveled = df.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(levels)])))
    return leveled, F.pow(F.lit(2.0), F.col("level"))


def cover(df: DataFrame, start: Column, end: Column, levels: int, keep: list[str]) -> DataFrame:
    """(keep, level, node): the disjoint nodes making up ``[start, end)``.

    Below the top level at most one node sticks out on either side; the top
    level takes whatever is left, so any length is covered exactly.
    """
    leveled, width = _by_level(df.withColumns({"_from": start, "_to": end}), levels)
    low = F.ceil(F.col("_from") / width).cast("bigint")
    high = F.floor(F.col("_to") / width).cast("bigint")
    leveled = leveled.withColumns({"_low": low, "_high": high}).where("_low < _high")
    low, high = F.col("_low"), F.col("_high")
    sides = F.array_compact(F.array(F.when(low % 2 != 0, low), F.when(high % 2 != 0, high - 1)))
    nodes = F.when(F.col("level") == levels - 1, F.sequence(low, high - 1)).otherwise(sides)
    return leveled.select(*keep, "level", F.explode(nodes).alias("node"))


def path(df: DataFrame, point: Column, levels: int, keep: list[str]) -> DataFrame:
    """(keep, level, node): the node holding ``point`` on every level."""
    leveled, width = _by_level(df.withColumn("_from", point), levels)
    return leveled.select(*keep, "level", F.floor(F.col("_from") / width).cast("bigint").alias("node"))


def time_unit(df: DataFrame, start: str, end: str) -> int:
    """Coarsest unit (in microseconds) that expresses every bound exactly.

    One scalar row reaches the driver. Whole minutes, the usual case, need 9
    levels for an eight-hour interval instead of 35.
    """
    exact = df.agg(*[
        F.coalesce(F.bool_and((epoch_micros(F.col(start)) % u == 0)
                              & (epoch_micros(F.col(end)) % u == 0)), F.lit(True)) for u in _UNITS
    ]).first()
    return next(u for u, ok in zip(_UNITS, exact) if ok)


def _levels(longest_minutes: int, unit: int) -> int:
    return max(1, (longest_minutes * 60_000_000 // unit).bit_length())


def _grid(df: DataFrame, start: str, end: str, unit: int) -> DataFrame:
    return df.withColumns({
        "_s": F.floor(epoch_micros(F.col(start)) / F.lit(unit)).cast("bigint"),
        "_e": F.floor(epoch_micros(F.col(end)) / F.lit(unit)).cast("bigint"),
    })


def _probe(asked: DataFrame, stored: DataFrame, key: str, resource: str, levels: int) -> DataFrame:
    """(key, _hit): lowest key of the stored intervals overlapping each asked one.

    ``_s``/``_e`` must be set on both sides. A stored interval that covers the
    asked start strictly is found on the asked start's path; one that starts
    inside the asked interval is found on the asked cover.
    """
    node = [resource, "level", "node"]
    held = [resource, key]
    covering = cover(stored.where(F.col("_e") > F.col("_s") + 1), F.col("_s") + 1, F.col("_e"),
                     levels, held).groupBy(*node).agg(F.min(key).alias("_v"))
    starting = path(stored, F.col("_s"), levels, held).groupBy(*node).agg(
        F.min(key).alias("_v"))
    narrow = [key, resource]
    on_path = path(asked, F.col("_s"), levels, narrow).join(covering, node)
    in_cover = cover(asked, F.col("_s"), F.col("_e"), levels, narrow).join(starting, node)
    return (
        on_path.select(key, "_v").unionByName(in_cover.select(key, "_v"))
        .groupBy(key).agg(F.min("_v").alias("_hit"))
    )


def overlap_hits(asked: DataFrame, stored: DataFrame, key: str, resources: Mapping[str, str],
                 start: str, end: str) -> DataFrame:
    """(key, one column per entry): how many ``stored`` intervals overlap each
    asked row on each resource; ``resources`` maps the result column to the
    resource column. Rows in nobody's way are absent.

    All resources share one pass. Stored rows are first cut to the time some
    request of their resource touches, so a large history is mostly dropped
    before the shuffle. Rows that end before they start overlap nothing.
    """
    place = ["_kind", "_resource"]

    def located(df: DataFrame, *columns: str) -> DataFrame:
        places = F.array(*[
            F.struct(F.lit(i).alias("_kind"), F.col(r).alias("_resource"))
            for i, r in enumerate(resources.values())])
        return df.select(*columns, start, end, F.explode(places).alias("_p")).select(
            *columns, start, end, "_p.*")

    def points(df: DataFrame, opening: int, closing: int, who, weight: int) -> DataFrame:
        # At one instant: ends, then questions, then starts.
        def point(ts: str, rank: int, is_end: bool):
            return F.struct(F.col(ts).alias("_t"), F.lit(rank).alias("_rank"),
                            F.lit(is_end).alias("_end"))
        both = F.array(point(start, opening, False), point(end, closing, True))
        return df.select(*place, who.alias(key), F.lit(weight).alias("_w"),
                         F.explode(both).alias("_x")).select(*place, key, "_w", "_x.*")

    forward = F.col(start) <= F.col(end)
    asked = located(asked.where(forward), key)
    near = _near(located(stored.where(forward)), asked, place, start, end)
    nobody = F.lit(None).cast(asked.schema[key].dataType)
    line = points(near, 2, 0, nobody, 1).unionByName(points(asked, 1, 1, F.col(key), 0)).select(
        *place, key, "_t", "_rank", "_end",
        F.when(F.col("_end"), 0).otherwise(F.col("_w")).alias("_starts"),
        F.when(F.col("_end"), F.col("_w")).otherwise(0).alias("_ends"))
    answered = running(line, place, ["_t", "_rank"], {
        "_begun": F.col("_starts"), "_over": F.col("_ends")}).where(F.col("_rank") == 1)
    # Asked at its end: starts so far. Asked at its start: ends so far.
    count = F.when(F.col("_end"), F.col("_begun")).otherwise(-F.col("_over"))
    totals = [F.sum(F.when(F.col("_kind") == i, count).otherwise(0)).alias(out)
              for i, out in enumerate(resources)]
    return answered.groupBy(key).agg(*totals).where(
        F.greatest(*[F.col(c) for c in resources], F.lit(0)) > 0)


def overlap_counts(asked: DataFrame, stored: DataFrame, key: str, resources: Mapping[str, str],
                   start: str, end: str) -> DataFrame:
    """``asked`` plus the number of stored intervals overlapping each row."""
    hits = overlap_hits(asked, stored, key, resources, start, end)
    return asked.join(hits, key, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in resources})


def earliest_among(asked: DataFrame, others: DataFrame, key: str, resource: str, start: str,
                   end: str, out: str, unit: int, longest_minutes: int) -> DataFrame:
    """(key, out): lowest ``key`` among the ``others`` of the same resource
    overlapping each asked row; rows without one are absent."""
    levels = _levels(longest_minutes, unit)
    columns = [key, resource, start, end]
    return _probe(_grid(asked.select(*columns), start, end, unit),
                  _grid(others.select(*columns), start, end, unit), key, resource,
                  levels).select(key, F.col("_hit").alias(out))


def _near(stored: DataFrame, asked: DataFrame, place: list[str], start: str, end: str) -> DataFrame:
    """Stored rows between the first start and the last end asked of their
    resource, however long they are."""
    asked = asked.groupBy(*place).agg(F.min(start).alias("_first"), F.max(end).alias("_last"))
    return (stored.join(asked, place)
            .where((F.col(start) < F.col("_last")) & (F.col(end) > F.col("_first")))
            .drop("_first", "_last"))
