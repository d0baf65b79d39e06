"""The registered queries of the corpus operators: thin digests of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilia.llm import ann, bpe, chat, collocations, decontaminate, fixity, imatch, neardup, packing, repeats, secrets, toxicity, trie
from vigilia.llm import sql
from vigilia.llm.tables import table


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), "doc_id")

    def listed(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        _sha(listed("base")).alias("base_sha256"), listed("found").alias("spans"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra), _tokenizer("byte_bpe_50k.json")))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imatch.fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = toxicity.held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which records have failed."""
    pages = table(spark, sf_dir, "pages").select("page_id", fixity.record(F.col("url"), F.col("html")).alias("raw"))
    replica = pages.select("page_id", F.sha2("raw", 256).alias("id"), fixity.failing(F.col("page_id"), F.col("raw"), 50).alias("raw"))
    ours, theirs = (fixity.stored(x, "records") for x in fixity.lay_out(fixity.manifest(pages), fixity.manifest(replica)))
    return fixity.compared(ours, theirs).select(
        "page_id", "copies", "segment", "part", "number", "start", "length", F.col("content").alias("record_sha256"), "status")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the nodes' names, which SQL has no way to give."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        _sha(F.concat_ws(",", "items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_neardup, op3_chat, op4_imatch, op5_toxicity, op6_bpe, op7_ann, op8_repeats, op9_warc,
    op10_packing, op11_trie, op12_collocations, op13_decontaminate,
    pipeline)}
ORACLES: dict[str, str] = {"op11_trie": sql.TRIE, "op12_collocations": sql.PHRASES, "op13_decontaminate": sql.LEAKS}
