"""Where intermediate tables go: the cluster's shared checkpoint folder.

Every application has a folder of its own there, which goes when its driver
ends. A long-running one frees what a job wrote with `scratch`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Without it, a subfolder of the session's warehouse, which a cluster shares
    as well; the setting is left as it is.
    """
    context = spark.sparkContext
    folder = (spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
              or context.getCheckpointDir())
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


_leaving: set[str] = set()
_begun: ContextVar[list[str] | None] = ContextVar("begun", default=None)


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def _own_folder(spark: SparkSession) -> str:
    """This application's folder, marked to be removed when the driver's JVM ends."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _leaving:
        files, place = _file_system(spark, own)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _leaving.add(own)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    begun = _begun.get()
    if begun is not None:
        begun.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders begun inside are removed at the end, whether it comes by an error
    or not. Results are lazy and read those folders: write them inside.

    Checkpoints of `materialise` are Spark's own; it removes them once nothing refers
    to them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    token = _begun.set([])
    try:
        yield
    finally:
        begun = _begun.get() or []
        _begun.reset(token)
        for path in begun:
            files, place = _file_system(spark, path)
            files.delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to and read from the shared folder: compressed, read by
    column, and with a lineage that ends here."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that a lost executor costs a
    re-read of the written rows and not a replay of every earlier round."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
