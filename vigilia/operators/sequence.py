"""Ordered operators whose work is split evenly whatever the sizes of the keys:
see `ranges`, the one path that all keys take.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from vigilia.operators.ranges import latest, moved


def shifted(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, out: str, step: int) -> DataFrame:
    """Value of the previous (``step=-1``) or next (``step=1``) row of the key
    in (ts, tie) order."""
    return moved(df, keys, [ts, tie], value, out, step)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
              right_tie: str, payload: Sequence[str]) -> DataFrame:
    """Every left row with the latest right row of its key at or before it.

    Equal right times go to the highest ``right_tie``; left rows without a
    match keep NULL payload. Both sides travel in one shuffle; no pairs are
    made.
    """
    value = F.struct(*payload)
    none = F.lit(None)
    lefts = left.select(
        *keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
        none.cast(right.schema[right_tie].dataType).alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
        none.cast(right.select(value.alias("v")).schema["v"].dataType).alias("_value"),
    )
    rights = right.select(
        *keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(right_tie).alias("_tie"),
        none.cast(lefts.schema["_row"].dataType).alias("_row"), value.alias("_value"),
    )
    found = latest(lefts.unionByName(rights), keys, ["_t", "_side", "_tie"], "_value", "_found")
    return found.where("_side = 1").select("_row.*", *[F.col("_found")[c].alias(c) for c in payload])


def nearest_daily(scans: DataFrame, schedule: DataFrame, key: str, second: str, slot: str,
                  slot_id: str, tolerance: int, wrap: bool = True) -> DataFrame:
    """Closest daily slot of the key for every scan, within ``tolerance`` seconds.

    ``second`` is the scan's second of day (fractions allowed), ``slot`` the
    slot's. Equal distances go to the lowest ``slot_id``; scans without a slot
    in reach get NULL. With ``wrap`` the clock is circular.

    Both sides shrink to distinct seconds of the day per key first, so a group
    never exceeds 86 400 rows a side whatever the key's share of the table is.
    """
    day = 86_400
    slots = schedule.groupBy(key, F.col(slot).alias("_at")).agg(F.min(slot_id).alias("_id"))
    if wrap:
        slots = slots.select(
            key, F.explode(F.array(F.col("_at") - day, F.col("_at"), F.col("_at") + day)).alias("_at"),
            "_id",
        ).where(F.col("_at").between(-tolerance - 1, day + tolerance + 1))
    whole = F.floor(F.col(second)).cast("int")
    asked = scans.select(key, whole.alias("_at")).distinct()
    both = asked.withColumn("_slot", F.lit(None).cast("struct<at:int,id:bigint>")).unionByName(
        slots.select(key, "_at", F.struct(F.col("_at").cast("int").alias("at"),
                                          F.col("_id").cast("bigint").alias("id")).alias("_slot")))
    before = (Window.partitionBy(key).orderBy("_at")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = (Window.partitionBy(key).orderBy("_at").rangeBetween(1, Window.unboundedFollowing))
    neighbours = (
        both.withColumns({
            "_before": F.last("_slot", ignorenulls=True).over(before),
            "_after": F.first("_slot", ignorenulls=True).over(after),
        })
        .where(F.col("_slot").isNull())
        .select(key, "_at", "_before", "_after")
    )
    down = F.col(second) - F.col("_before.at")
    up = F.col("_after.at") - F.col(second)
    choice = F.least(
        F.when(down <= tolerance, F.struct(down.cast("double").alias("gap"),
                                           F.col("_before.id").alias("id"))),
        F.when(up <= tolerance, F.struct(up.cast("double").alias("gap"),
                                         F.col("_after.id").alias("id"))),
    )
    return (
        scans.withColumn("_at", whole)
        .join(neighbours, [key, "_at"], "left")
        .withColumn(slot_id, choice["id"])
        .drop("_at", "_before", "_after")
    )
