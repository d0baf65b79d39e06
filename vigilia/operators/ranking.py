"""First rows per key and shares within a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANK = "_rank"


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of every key under a total ``order``.

    The filter on row_number lets Spark cut each map partition to ``k`` rows
    per key before the shuffle (WindowGroupLimit), so a key holding most of
    the table sends only ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= k).drop(_RANK)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Most recent row of every key; equal times go to the highest ``tie``."""
    return top_k_per_key(df, keys, [F.col(ts).desc_nulls_first(), F.col(tie).desc()], 1)


def share_within(df: DataFrame, group: Sequence[str], of: Sequence[str], count: str, share: str,
                 digits: int = 1) -> DataFrame:
    """Row count per ``group + of`` and its percentage of the ``group``.

    The window runs over the already aggregated rows.
    """
    counted = df.groupBy(*group, *of).agg(F.count(F.lit(1)).alias(count))
    whole = F.sum(count).over(Window.partitionBy(*group))
    return counted.withColumn(share, F.round(F.lit(100.0) * F.col(count) / whole, digits))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str],
                 count: Column | None = None) -> DataFrame:
    """Long to wide with zero fill; the listed values fix the columns, so no
    extra pass looks for distinct ones."""
    cells = [
        F.coalesce(F.sum(F.when(F.col(column) == v, count if count is not None else F.lit(1))),
                   F.lit(0)).cast("bigint").alias(v)
        for v in values
    ]
    return df.groupBy(row).agg(*cells)


def counts_by(df: DataFrame, attribute: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Row count per attribute value; listed labels without rows count 0."""
    counted = df.groupBy(F.col(attribute)).agg(F.count(F.lit(1)).alias("total"))
    if labels is None:
        return counted
    wanted = df.sparkSession.createDataFrame([(x,) for x in labels], f"{attribute} STRING")
    return wanted.join(counted, attribute, "left").select(
        attribute, F.coalesce("total", F.lit(0)).alias("total"))


def head_and_rest(df: DataFrame, order: Sequence[Column], k: int = 5) -> DataFrame:
    """First ``k`` rows plus how many more there are."""
    rest = df.agg(F.greatest(F.count(F.lit(1)) - F.lit(k), F.lit(0)).alias("n"))
    return df.orderBy(*order).limit(k).withColumn("restantes", rest.scalar())
