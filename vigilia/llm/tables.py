"""Reading the corpus tables, and intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilia.sources.work import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to and read from the shared folder: lineage ends here,
    and a lost executor costs a re-read only."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, version) of the ids that stand for several texts, a row for each
    text's key: usually none. Only keys are shuffled."""
    pairs = docs.where("doc_id is not null").select("doc_id", text_key().alias("version")).distinct()
    ends = pairs.groupBy("doc_id").agg(F.min("version").alias("low"), F.max("version").alias("high")).where("low < high")
    return stored(pairs.join(ends.select("doc_id"), "doc_id", "left_semi"), "shared")
