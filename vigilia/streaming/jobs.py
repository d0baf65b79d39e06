"""Running the rules on unbounded feeds.

Stateless rules append to a file sink, whose log makes each batch count once.
Keyed rules keep their state in the table they write, as the database does:
every batch owns the folder ``batch=<id>``, writes it with overwrite and reads
only earlier ones, so a batch replayed after a failure gives the same rows.
The work inside a batch is the batch operator itself, with its handling of
keys that hold a large part of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from vigilia.operators.ranking import latest_per_key
from vigilia.operators.suppress import suppress
from vigilia.sources.work import materialise
from vigilia.streaming.windows import pane_counts

BATCH = StructField("batch", LongType())


def append_to(df: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet files; without ``every`` it takes what is
    there now and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).option("path", out)
    return _start(writer, every)


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
               every: str | None = None) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return _start(writer, every)


def _start(writer, every: str | None) -> StreamingQuery:
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _folder(out: str, batch: int) -> str:
    return f"{out}/batch={batch}"


#: Every so many batches a table of latest rows is written whole.
FOLD = 16


def _batches(spark, out: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema, BATCH])).parquet(out)


def keep_latest(stream: DataFrame, key: str, ts: str, tie: str, out: str, checkpoint: str,
                every: str | None = None, fold: int = FOLD) -> StreamingQuery:
    """The latest row per key; read it with `latest_rows`.

    ``batch=<n>`` holds the latest rows of the keys that batch n brought, so what
    a batch writes follows the batch; every ``fold``-th holds the table so far.
    """

    def write(rows: DataFrame, batch: int) -> None:
        if batch > 0 and batch % fold == 0:
            earlier = _batches(rows.sparkSession, out, rows.schema).where(
                (F.col("batch") >= batch - fold) & (F.col("batch") < batch))
            rows = rows.unionByName(earlier.drop("batch"))
        latest_per_key(rows, [key], ts, tie).write.mode("overwrite").parquet(_folder(out, batch))

    return each_batch(stream, write, checkpoint, every)


def latest_rows(spark, out: str, schema: StructType, key: str, ts: str, tie: str, fold: int = FOLD) -> DataFrame:
    """The table that `keep_latest` keeps: a late row never replaces a newer one."""
    rows = _batches(spark, out, schema)
    last = rows.agg(F.max("batch").alias("b"))
    whole = last.select((F.floor(F.col("b") / fold) * fold).alias("b")).scalar()
    return latest_per_key(rows.where(F.col("batch") >= whole).drop("batch"), [key], ts, tie)


def keep_panes(stream: DataFrame, key: str, ts: str, slide: int, out: str, checkpoint: str,
               every: str | None = None) -> StreamingQuery:
    """``batch=<n>`` holds batch n's own counts per key and pane, for
    `windows.rolling_counts`; a replayed batch writes the same."""
    return each_batch(stream, lambda rows, batch: pane_counts(rows, key, ts, slide).write.mode(
        "overwrite").parquet(_folder(out, batch)), checkpoint, every)


def keep_counts(counts: DataFrame, out: str, checkpoint: str,
                every: str | None = None) -> StreamingQuery:
    """A small table of counts as it stands. ``batch=<n>`` holds all of
    it after batch n."""
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return _start(writer.foreachBatch(
        lambda rows, batch: rows.write.mode("overwrite").parquet(_folder(out, batch))), every)


def fire_quietly(candidates: DataFrame, keys: Sequence[str], ts: str, tie: str, quiet: int,
                 out: str, checkpoint: str, closed: Callable[[], DataFrame] | None = None,
                 every: str | None = None,
                 also: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
                 fold: int = FOLD) -> StreamingQuery:
    """Write the candidates that fire, given the alerts already written.

    What a batch needs to know of earlier ones is the latest alert per key. It lies
    in ``_latest`` under ``out``, which readers of ``out`` pass over: batch n's own
    keys, and every ``fold``-th batch those of all so far, so a batch reads at most
    ``fold`` folders however many came before.

    ``closed`` re-reads the closing times (keys + ``ts``) for every batch. A
    candidate older than an active alert stays silent, as in the database.

    ``also`` maps a folder to what is written there of the rows that fire, under
    the same batch id and before the rows themselves. A batch counts once its
    rows are written: `batch_output` leaves out what a broken batch left behind,
    and the batch that is run again overwrites it.
    """

    def work(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        carry = earlier = None
        state = StructType([rows.schema[c] for c in (*keys, ts)])
        if batch > 0:
            since = range((batch - 1) // fold * fold, batch)
            earlier = spark.read.schema(state).parquet(*[_folder(latest, b) for b in since])
            # Only alerts still within the quiet period of this batch can matter.
            first = rows.agg((F.min(ts) - F.make_dt_interval(secs=F.lit(quiet))).alias("t"))
            carry = earlier.groupBy(*keys).agg(F.max(ts).alias(ts)).where(F.col(ts) >= first.scalar())
        fired = suppress(rows, keys, ts, tie, quiet, closed=closed() if closed else None,
                         carry=carry)
        if also:
            fired = materialise(fired)
        for folder, derived in (also or {}).items():
            derived(fired).write.mode("overwrite").parquet(_folder(folder, batch))
        fired.write.mode("overwrite").parquet(_folder(out, batch))
        known = spark.read.schema(rows.schema).parquet(_folder(out, batch)).select(*keys, ts)
        if earlier is not None and batch % fold == 0:
            known = known.unionByName(earlier)
        known.groupBy(*keys).agg(F.max(ts).alias(ts)).write.mode("overwrite").parquet(_folder(latest, batch))

    latest = f"{out}/_latest"
    return each_batch(candidates, work, checkpoint, every)


def batch_output(spark, folder: str, schema: StructType, out: str, fired: StructType) -> DataFrame:
    """A further output of `fire_quietly`, of the batches whose rows are written."""
    done = _batches(spark, out, fired).select("batch").distinct()
    return _batches(spark, folder, schema).join(done, "batch", "left_semi").drop("batch")
