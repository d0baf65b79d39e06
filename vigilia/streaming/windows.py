"""Event-time counts over sensor feeds.

Windows need a zoned timestamp, so the zone-less event time is cast in and the
window bounds are cast back; the session runs in UTC. Daily counts keep a row
per day and feed as state and hence count every row, however late. Sliding counts
are made of panes: each batch adds its rows' counts per key and slide, so a late
row is added to its windows whenever it comes, and no watermark drops any.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from vigilia.functions.clock import epoch_micros
from vigilia.operators.ranges import moved, running


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_event", F.col(ts).cast("timestamp"))


def _bounds() -> list:
    return [F.col("_window.start").cast("timestamp_ntz").alias("desde"),
            F.col("_window.end").cast("timestamp_ntz").alias("hasta")]


def daily_feed_counts(feeds: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Events per day and feed, open days and late rows included; ``feeds`` maps
    a label to (stream, time column). For `jobs.keep_counts`. Sum the days to
    get the totals of any longer period."""
    tagged = None
    for label, (df, ts) in feeds.items():
        part = df.select(F.lit(label).alias("tipo_evento"), F.col(ts).alias("_ts"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counted = _event_time(tagged, "_ts").groupBy(
        F.window("_event", "1 day").alias("_window"), "tipo_evento").agg(
        F.count(F.lit(1)).alias("total"))
    return counted.select(*_bounds(), "tipo_evento", "total")


def pane_counts(rows: DataFrame, key: str, ts: str, slide: int) -> DataFrame:
    """(key, pane, total): rows per key and stretch of ``slide`` seconds, numbered
    since the epoch. For `jobs.keep_panes`; rows without a key or time are in none."""
    pane = F.floor(epoch_micros(F.col(ts)) / F.lit(slide * 1_000_000)).alias("pane")
    return rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, pane).agg(
        F.count(F.lit(1)).alias("total"))


def rolling_counts(panes: DataFrame, key: str, length: int, slide: int) -> DataFrame:
    """Events per key over windows of ``length`` seconds every ``slide`` seconds,
    the live form of the 48 h summary: (key, desde, hasta, total), no empty window.

    ``panes`` are `pane_counts` of any number of batches, a late row's included.
    A pane enters the windows at its end and leaves them ``length`` later, so a
    running sum of both gives every window's total; a total that lasts is spread
    over its windows at the end only. ``slide`` must divide ``length``.
    """
    wide = length // slide
    each = panes.groupBy(key, "pane").agg(F.sum("total").alias("total"))
    turns = F.array(F.struct((F.col("pane") + 1).alias("at"), F.col("total").alias("by")),
                    F.struct((F.col("pane") + 1 + wide).alias("at"), (-F.col("total")).alias("by")))
    steps = each.select(key, F.explode(turns).alias("x")).groupBy(key, F.col("x.at").alias("at")).agg(
        F.sum("x.by").alias("by"))
    held = running(steps, [key], ["at"], {"total": F.col("by")})
    until = moved(held, [key], ["at"], "at", "until", 1).where("total > 0")
    ends = until.withColumn("end", F.explode(F.sequence("at", F.col("until") - 1)))

    def moment(number):
        return F.timestamp_seconds(number * slide).cast("timestamp_ntz")

    return ends.select(key, moment(F.col("end") - wide).alias("desde"), moment(F.col("end")).alias("hasta"), "total")
