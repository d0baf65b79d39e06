"""I-Match document fingerprints, in DataFrame functions only.

A term counts if its document frequency lies in a band: frequent terms say
little, rare ones break with every typo. The lexicon of the band is dealt at
random into ``SUBSETS`` lexicons; a text's distinct terms are sorted and hashed
once per lexicon. Equal texts agree in all hashes, and the share of lexicons in
which two texts agree falls with the share of terms they have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SUBSETS = 32
#: Hexadecimal digits of one lexicon's hash.
DIGITS = 6
#: The band, as shares of all documents. A text of t distinct terms adds t to
#: the sum of frequencies, so at most mean(t) / LOW terms reach LOW: the lexicon
#: follows the mean length of a text, never their number.
LOW, HIGH = 0.005, 0.2
#: A text with fewer terms in the band is hashed over all its terms.
FEW = 4
#: Most ranges of ids whose first rows are broadcast: 24 bytes each.
RANGES = 65_536
_PER_RANGE = 512
_WORDS = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    split = F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")
    return F.array_distinct(F.transform(split, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms whose share of all documents is in [low, high]."""
    total = docs.count()
    frequencies = docs.select(F.explode(terms(F.coalesce("text", F.lit(""))))
                              .alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = frequencies.where(F.col("df").between(max(2, low * total), high * total))
    return sorted(r.term for r in band.select("term").collect())


def add_fingerprint(df: DataFrame, text: str, out: str, band: list[int]) -> DataFrame:
    """``df`` with the fingerprint of column ``text``: ``SUBSETS`` groups of
    ``DIGITS`` hexadecimal digits, ``-`` where a lexicon has none of its terms.

    Hashes are uniform, so a lexicon is a range of them. Each step is a column of
    its own: Catalyst keeps them apart and works out the terms once.
    """
    df = df.withColumn("_every", terms(F.col(text)))
    if band:
        inside = F.expr(f"filter(_every, x -> x IN ({', '.join(map(str, band))}))")
        df = df.withColumn("_band", inside)
        df = df.withColumn("_kept", F.array_sort(F.when(F.size("_band") >= FEW, F.col("_band")).otherwise(F.col("_every"))))
    else:
        df = df.withColumn("_kept", F.array_sort("_every"))
    step = 2**64 // SUBSETS

    def one(k: int) -> Column:
        least, most = k * step - 2**63, (k + 1) * step - 1 - 2**63
        own = F.filter("_kept", lambda t: (t >= F.lit(least)) & (t <= F.lit(most)))
        joined = F.concat_ws(",", own.cast("array<string>"))
        return F.when(joined == "", "-" * DIGITS).otherwise(F.substring(F.md5(joined), 1, DIGITS))

    return df.withColumn(out, F.concat(*(one(k) for k in range(SUBSETS)))).drop("_every", "_band", "_kept")


def likeness(a: Column, b: Column) -> Column:
    """Share of the lexicons that either text uses in which both hash alike; 1
    for equal fingerprints."""
    def part(f: Column, k: int) -> Column:
        return F.substring(f, 1 + k * DIGITS, DIGITS)

    none = "-" * DIGITS
    same = sum((F.when((part(a, k) == part(b, k)) & (part(a, k) != none), 1).otherwise(0) for k in range(SUBSETS)), F.lit(0))
    used = sum((F.when((part(a, k) != none) | (part(b, k) != none), 1).otherwise(0) for k in range(SUBSETS)), F.lit(0))
    return F.when(a == b, F.lit(1.0)).otherwise(same / used)


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_<c>`` of the next row by doc_id
    for each carried column; the last row's next is the first row.

    Rows are cut into ranges of ids, at most ``RANGES``; the first row of a
    range is also sent to the range before it, so texts are shuffled once and
    each range is sorted by itself.
    """
    span = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    low, high, count = (int(v or 0) for v in span)
    ranges = max(1, min(RANGES, count // _PER_RANGE))
    width = (high - low) // ranges + 1
    own = F.expr(f"(coalesce(doc_id, {low}L) - {low}L) div {width}L")
    firsts = (docs.where("doc_id is not null").select("doc_id", own.alias("_range"))
              .groupBy("_range").agg(F.min("doc_id").alias("doc_id")))
    # At most RANGES rows, hence one window and a broadcast.
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    last = F.max("_range").over(Window.partitionBy(F.lit(0)))
    ahead = firsts.select("doc_id", F.coalesce(F.lag("_range").over(order), last).alias("_before"))
    rows = docs.join(F.broadcast(ahead), "doc_id", "left").withColumn("_range", own)
    own_copy = F.struct(F.col("_range").alias("range"), F.lit(False).alias("ahead"))
    ahead_copy = F.struct(F.col("_before").alias("range"), F.lit(True).alias("ahead"))
    copies = F.when(F.col("_before").isNull(), F.array(own_copy)).otherwise(F.array(own_copy, ahead_copy))
    rows = rows.withColumn("_copy", F.explode(copies))
    inside = Window.partitionBy(F.col("_copy.range")).orderBy(F.col("_copy.ahead"), "doc_id", F.xxhash64("text"))
    return (rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in carried})
            .where(~F.col("_copy.ahead")).drop("_copy", "_range", "_before"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text and the fingerprints of both and of the next
    document, for every row.

    The edited text replaces the last floor(n / 2) of n code points by the first
    as many (or all) of the next document's. Null texts are empty. Equal ids are
    ordered by their text's hash; null ids go before the smallest. Empty texts
    share one fingerprint; a missing next text is empty.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = lexicon(base)
    marked = add_fingerprint(base, "text", "fingerprint", band)
    rows = with_next(marked, "text", "fingerprint")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"),
                       "fingerprint", "next_fingerprint")
    return add_fingerprint(rows, "edited", "edited_fingerprint", band)
