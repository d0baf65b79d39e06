"""A corpus in five stages: toxic documents go, one of each group of near copies
stays, repeated passages go, secrets are blanked, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns the columns of `documents`, the last one the packed pieces. ``run``
writes each result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilia.llm import neardup, packing, repeats, secrets, toxicity
from vigilia.llm.tables import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of those labelled among them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies: five words, similarity 0.8."""
    return neardup.keep_one(docs.select(*COLUMNS), size=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier in the corpus are left out; texts
    without any stay as they are."""
    rows = repeats.remove_repeats(docs.select(*COLUMNS), "lang", "source", "n_chars")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source",
                       F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint"))
                       .otherwise(F.col("n_chars")).alias("n_chars"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by its kind in brackets."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: see `packing.pack`; ids as their checksum."""
    return packing.pack(docs, _tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeats", drop_repeats),
    ("secrets", blank_secrets),
    ("packing", pack),
]

#: No stage but the secrets' fixed patterns can be said in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
