"""Time filters that also prune the day folders of tables written by day.

`read_table` notes on the event time column which column its folders follow.
From the same time span these filters give a predicate on that column, so Spark
lists and reads the folders in question only, without being told a span; other
tables are filtered by time alone. Both predicates hold for the same rows.

    t["acceso_rfid"].transform(layout.rows_on_day, "accedido_en", as_of)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilia.functions import clock

DAY_COLUMN = "dia"
_NOTE = "day_folders"


def noted(df: DataFrame, ts: str) -> DataFrame:
    """``df`` without its layout column, which filters by ``ts`` still reach."""
    rest = [c for c in df.columns if c != DAY_COLUMN]
    return df.withMetadata(ts, {_NOTE: DAY_COLUMN}).select(*rest)


def _folders(df: DataFrame, ts: str, first: Column, last: Column | None = None) -> DataFrame:
    folder = df.schema[ts].metadata.get(_NOTE)
    if folder is None:
        return df
    # Not among the columns any more: Spark finds it below the projection that left it out.
    df = df.where(F.col(folder) >= first)
    return df if last is None else df.where(F.col(folder) <= last)


def rows_since(df: DataFrame, ts: str, as_of, **parts: int) -> DataFrame:
    """`clock.since`: rows dated after ``as_of`` pass."""
    return _folders(df, ts, F.to_date(clock.ago(as_of, **parts))).where(clock.since(F.col(ts), as_of, **parts))


def rows_on_day(df: DataFrame, ts: str, moment) -> DataFrame:
    """`clock.on_day`."""
    return _folders(df, ts, clock.day(moment), clock.day(moment)).where(clock.on_day(F.col(ts), moment))


def rows_in_week(df: DataFrame, ts: str, first_day) -> DataFrame:
    """`clock.in_week`."""
    first = clock.day(first_day)
    return _folders(df, ts, first, F.date_add(first, 6)).where(clock.in_week(F.col(ts), first_day))
