"""Reading and writing the declared tables, in batch and as feeds."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilia.sources.layout import DAY_COLUMN, noted
from vigilia.sources.schemas import EVENT_TIME


def load_tables(
    spark: SparkSession,
    path: str,
    schemas: Mapping[str, str],
    names: Iterable[str] | None = None,
    fmt: str = "parquet",
    first_day=None,
    last_day=None,
) -> dict[str, DataFrame]:
    """Lazily open ``path/<table>`` for every declared table.

    The schema is always the declared one, never inferred, so opening a table
    costs no scan. ``fmt`` is any built-in file format (parquet, orc, csv,
    json); CSV files are expected to carry a header. Event tables written by
    day are pruned by the reports' own time filters (`layout`); ``first_day``
    and ``last_day`` cut them to a span besides.
    """
    return {
        name: read_table(spark, os.path.join(path, name), schemas[name], fmt, first_day, last_day)
        for name in (names if names is not None else schemas)
    }


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", first_day=None,
               last_day=None) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    elif fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return day_range(reader.load(path), first_day, last_day)


def write_table(df: DataFrame, path: str, name: str | None = None, fmt: str = "parquet",
                mode: str = "append") -> None:
    """Write a table; event tables are laid out by day so that the relative
    windows and calendar-day filters of the reports prune directories.

    Rows are clustered by day before the write: each task then holds few days
    and leaves few files. A day holding most of the rows is split by AQE's
    rebalance instead of landing in one task.
    """
    writer_df, days = df, []
    if name in EVENT_TIME:
        writer_df = df.withColumn(DAY_COLUMN, F.to_date(EVENT_TIME[name])).hint(
            "rebalance", F.col(DAY_COLUMN))
        days = [DAY_COLUMN]
    writer = writer_df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if days:
        writer = writer.partitionBy(*days)
    writer.save(path)


def day_range(df: DataFrame, first=None, last=None) -> DataFrame:
    """A day-partitioned event table cut to the days ``[first, last]``, without
    the layout column; a table not laid out by day is returned as is. Time filters
    of `layout` go on pruning the folders."""
    if DAY_COLUMN not in df.columns:
        return df
    if first is not None:
        df = df.where(F.col(DAY_COLUMN) >= F.to_date(F.lit(str(first)[:10])))
    if last is not None:
        df = df.where(F.col(DAY_COLUMN) <= F.to_date(F.lit(str(last)[:10])))
    times = {c for c in EVENT_TIME.values() if c in df.columns}
    return noted(df, times.pop()) if len(times) == 1 else df.drop(DAY_COLUMN)


def read_feed(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """An append-only directory of sensor rows as an unbounded table."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)
