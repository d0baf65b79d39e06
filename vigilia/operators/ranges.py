"""Ordered work on any distribution of keys: ranges, and one border row a range.

Rows are dealt by (keys, order) into ranges of about equal size, so that a key
of any size lies in as many neighbouring ranges as it needs and a small key in
one. Windows run per (range, key). Only the first key of a range can have begun
before it, so what crosses a border is worked out over one row a range, as many
as there are shuffle partitions, and joined back to that key's rows. All keys
take this one path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilia.sources.work import written

RANGE = "_range"
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the number of each row's range. Rows are kept, because ranges
    that are worked out again may be cut elsewhere."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def inside(keys: Sequence[str], order: Sequence[str]):
    """The window over one key's rows in one range."""
    return Window.partitionBy(RANGE, *keys).orderBy(*order)


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def borders(ranged: DataFrame, keys: Sequence[str], **edges: Column) -> DataFrame:
    """One row a range: its first and last key and the ``edges``, aggregates over its rows."""
    return ranged.groupBy(RANGE).agg(
        F.min(_key(keys)).alias("_low"), F.max(_key(keys)).alias("_high"),
        *[e.alias(name) for name, e in edges.items()])


def with_carried(ranged: DataFrame, carried: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``ranged`` with what ``carried`` (a row a range: ``_low`` and the columns)
    brings to the rows of the first key of each range, NULL for other rows. The
    broadcast side has as many rows as there are shuffle partitions at most."""
    rows = carried.select(F.col(RANGE).alias("_r"), "_low", *columns)
    return ranged.join(F.broadcast(rows), (F.col(RANGE) == F.col("_r")) & _key(keys).eqNullSafe(F.col("_low")),
                       "left").drop("_r", "_low")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with sums over the rows of the key up to and with each row.

    ``order`` must tell all rows of a key apart, or rows equal in it must be
    interchangeable. Sums are exact integers; take decimals where 64 bits may overflow.
    """
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    ranged = by_ranges(df.withColumns(values), keys, order)
    per_key = ranged.groupBy(RANGE, *keys).agg(*[F.sum(v).alias(v) for v in values])
    ends = borders(per_key, keys, _last=F.max_by(F.struct(*values), _key(keys)))
    so_far = Window.partitionBy("_high").orderBy(RANGE).rowsBetween(*_SO_FAR)
    before = Window.orderBy(RANGE)
    run = ends.select(RANGE, "_low", "_high", *[F.sum(F.col("_last")[v]).over(so_far).alias(f"{v}_run") for v in values])
    opened = F.lag("_high").over(before).eqNullSafe(F.col("_low"))
    carried = run.select(RANGE, "_low", *[F.when(opened, F.lag(f"{v}_run").over(before)).alias(f"{v}_before")
                                          for v in values])
    here = inside(keys, order).rowsBetween(*_SO_FAR)
    out = with_carried(ranged, carried, keys, [f"{v}_before" for v in values])
    return out.select(*df.columns, *[
        (F.sum(v).over(here) + F.coalesce(f"{v}_before", F.lit(0))).alias(name) for name, v in zip(sums, values)])


def moved(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, step: int) -> DataFrame:
    """``df`` with the ``value`` of the row before (``step=-1``) or after
    (``step=1``) in the key's ``order``, NULL at its end."""
    ranged = by_ranges(df, keys, order)
    place = F.struct(*[F.col(c) for c in (*keys, *order)])
    held = F.struct(F.col(value).alias("v"))
    ends = borders(ranged, keys, _first=F.min_by(held, place), _last=F.max_by(held, place))
    line, here = Window.orderBy(RANGE), inside(keys, order)
    if step < 0:
        touches = F.lag("_high").over(line).eqNullSafe(F.col("_low"))
        carried = ends.select(RANGE, "_low", F.when(touches, F.lag("_last").over(line)["v"]).alias("_carried"))
        shift, at_edge = F.lag(value).over(here), F.row_number().over(here) == 1
    else:
        touches = F.lead("_low").over(line).eqNullSafe(F.col("_high"))
        carried = ends.select(RANGE, F.col("_high").alias("_low"),
                              F.when(touches, F.lead("_first").over(line)["v"]).alias("_carried"))
        shift, at_edge = F.lead(value).over(here), F.lead(F.lit(1)).over(here).isNull()
    rows = with_carried(ranged, carried, keys, ["_carried"]).withColumns({"_moved": shift, "_edge": at_edge})
    return rows.select(*df.columns, F.when(F.col("_edge"), F.col("_carried")).otherwise(F.col("_moved")).alias(out))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the last non-null ``value`` of the key up to and with each row."""
    ranged = by_ranges(df, keys, order)
    place = F.struct(*[F.col(c) for c in (*keys, *order)])
    known = F.col(value).isNotNull()
    found = F.max_by(F.struct(_key(keys).alias("key"), F.col(value).alias("v")), F.when(known, place))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # Ranges follow the keys: if the last value before a range is not its first key's, that key has none.
    before = F.last("_found", ignorenulls=True).over(earlier)
    carried = (borders(ranged, keys, _found=found).withColumn("_before", before)
               .select(RANGE, "_low", F.when(F.col("_before")["key"].eqNullSafe(F.col("_low")), F.col("_before")["v"])
                       .alias("_carried")))
    so_far = F.last(value, ignorenulls=True).over(inside(keys, order).rowsBetween(*_SO_FAR))
    return with_carried(ranged, carried, keys, ["_carried"]).withColumn("_here", so_far).select(
        *df.columns, F.coalesce("_here", "_carried").alias(out))
