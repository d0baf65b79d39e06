"""New keys for appended rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilia.sources.work import materialise

def dense_ids(df: DataFrame, order: str, out: str, after: Column) -> DataFrame:
    """Consecutive ids ``after + 1, after + 2, ...`` in ``order``, a unique
    integer column.

    Rows are dealt into ranges of ``order`` of about equal size, as many as
    there are shuffle partitions, however its values are spread. The dealt rows
    are kept, so that counting and numbering see the same ranges; each range is
    offset by the rows before it, a sum over one row a range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (
        dealt.withColumn("_inside", inside).join(offsets, "_range")
        .withColumn(out, (after + F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_offset")
    )


def highest(df: DataFrame, key: str) -> Column:
    """Highest stored key, 0 for an empty table, as a scalar."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("m")).scalar()
