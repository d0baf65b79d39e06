"""WARC records and a Merkle fixity audit of their replicas.

Pages become WARC records, laid one after the other into segments of bounded
length. A leaf of a segment's tree is the hash of one record with its offset
range; an inner node hashes the ordered ranges and hashes of up to ``FANOUT``
children. Records hang in the tree by a hash of their page id and of the id they
were archived under, which all replicas know. Two replicas are compared by their
roots, and only the branches that differ are followed down to the records that do. Everything is a DataFrame: a
level is one aggregation over the one below.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilia.llm.tables import stored

FANOUT = 16
#: Records of one part of a segment, about.
SEGMENT = 1024
#: Page numbers of one range; a range with more rows is split by the records' ids.
_RANGE = 512
#: Nodes above the records of a part, each for the names of one share of the hashes.
_CELLS = SEGMENT // FANOUT


#: What a URI in a header may not hold as it is: controls and spaces.
_UNSAFE = [chr(i) for i in (*range(0x21), 0x7F)]
_END = "\r\n\r\n"


def _escaped(url: Column) -> Column:
    """Percent-encoded where ``_UNSAFE`` says so."""
    return functools.reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), _UNSAFE, url)


def _unsafe(url: Column) -> Column:
    return url.rlike(r"[\x00-\x20\x7F]")


def record(url: Column, html: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """The bytes of a WARC response record, its HTTP response inside; nulls are empty.

    The record's id is a UUID made of the hash of URL and page, so equal pages
    give equal records wherever they are written. A URL that holds spaces or
    controls is percent-encoded, and kept as it was, in Base64, in a field of its
    own. ``date`` is the time of capture, which a table of pages does not tell.
    """
    url, body = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit(_END))
    digest = F.sha2(F.concat(F.octet_length(url).cast("string").cast("binary"), F.lit(":").cast("binary"),
                             url.cast("binary"), body), 256)
    name = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("8"), F.substring(digest, 14, 3)),
                       F.concat(F.lit("a"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    kept = F.concat(F.lit("\r\nWARC-X-Original-URI: "), F.translate(F.base64(url.cast("binary")), "\r\n", ""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), name,
                    F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
                    F.when(_unsafe(url), F.concat(_escaped(url), kept)).otherwise(url),
                    F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
                    (F.octet_length(body) + F.octet_length(http)).cast("string"), F.lit(_END))
    return F.concat(head.cast("binary"), http.cast("binary"), body, F.lit(_END).cast("binary"))


def parse(raw: Column) -> Column:
    """struct(url, html) read back from a record; null where a header is broken
    or one of the two lengths is not the one stated."""
    parts = F.split(raw.cast("string"), _END, 3)
    head, http = parts[0], F.get(parts, F.lit(1))

    def field(block: Column, name: str) -> Column:
        return F.regexp_extract(block, rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)

    rest = F.octet_length(raw) - F.octet_length(head) - 2 * len(_END)
    left = rest - F.octet_length(http) - len(_END)
    good = (head.startswith("WARC/1.1\r\n") & http.startswith("HTTP/1.1 ") & (field(head, "Content-Length").try_cast("int") == rest)
            & (field(http, "Content-Length").try_cast("int") == left))
    body = F.substring(raw, F.octet_length(head) + F.octet_length(http) + 2 * len(_END) + 1, left)
    kept, uri = field(head, "WARC-X-Original-URI"), field(head, "WARC-Target-URI")
    url = F.when(kept != "", F.unbase64(kept).cast("string")).otherwise(uri)
    return F.when(good, F.struct(url.alias("url"), body.cast("string").alias("html")))


def write_archive(records: DataFrame, folder: str, per_file: int = SEGMENT) -> None:
    """The records' bytes ``raw`` as files of at most ``per_file`` records, one
    behind the other in order of page_id; ``folder`` must be new.

    A record's bytes are UTF-8 and end with the two empty lines, which are the
    separator Spark puts behind each of its text rows.
    """
    text = F.col("raw").cast("string")
    (records.repartitionByRange("page_id", F.xxhash64("raw")).sortWithinPartitions("page_id", F.xxhash64("raw"))
     .select(F.expr(f"left(raw, length(raw) - {len(_END)})").alias("raw")).select(text.alias("value"))
     .write.option("lineSep", _END).option("maxRecordsPerFile", per_file).text(folder))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of files, found by their stated lengths."""
    stated = re.compile(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)*?Content-Length: ([0-9]+)\r\n\r\n")
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data, at, rows = content.as_buffer().to_pybytes(), 0, []
            while at < len(data):
                head = stated.match(data, at)
                end = head.end() + int(head[1]) + len(_END) if head else len(data) + 1
                if end > len(data) or data[end - len(_END):end] != _END.encode():
                    # Not a record as stated: it lasts until the next one begins.
                    begun = data.find(b"\r\n\r\nWARC/1.1\r\n", at + 1)
                    end = begun + len(_END) if begun >= 0 else len(data)
                rows.append((path, at, data[at:end]))
                at = end
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "raw"), r)) for r in rows], _FILED)


_FILED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("raw", pa.binary())])


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(file, start, raw): every record of the files in ``folder`` with its offset.
    A damaged stretch without a readable header or length is one row, up to the next
    record; no byte is left out. A task holds one file at a time."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_records, "file string, start bigint, raw binary")


def manifest(records: DataFrame) -> DataFrame:
    """(page_id, id, content, length): the hash and length of each record's bytes
    ``raw``. Bytes are read where they lie and never move.

    ``id`` is the name a record was archived under, the hash of its bytes then. A
    replica has it as a column of its own and keeps it when bytes fail; without
    one, the records are the archive's own and are named now.
    """
    content = F.sha2("raw", 256)
    return records.select("page_id", (F.col("id") if "id" in records.columns else content).alias("id"),
                          content.alias("content"), F.octet_length("raw").cast("bigint").alias("length"))


def _known(listed: DataFrame) -> DataFrame:
    """One row for each (page_id, id) with its copies. If copies differ, each kind
    is kept once, and the content is a hash of them all."""
    kinds = listed.groupBy("page_id", "id", "content", "length").agg(F.count("*").alias("copies"))
    several = F.sha2(F.concat_ws(":", F.min("content"), F.max("content"),
                                 F.bit_xor(F.xxhash64("content", "copies")).cast("string")), 256)
    return kinds.groupBy("page_id", "id").agg(
        F.when(F.count("*") == 1, F.min("content")).otherwise(several).alias("content"),
        F.sum("length").alias("length"), F.sum("copies").alias("copies"),
    ).withColumn("segment", F.coalesce(F.floor(F.col("page_id") / _RANGE), F.lit(-1)).cast("bigint"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def lay_out(*replicas: DataFrame) -> list[DataFrame]:
    """The manifests' records with their places: + copies, segment, part, number,
    start (the offset in the part), and name and above, their place in the tree.

    Equal rows are one record with a count of copies. A segment holds records of
    one range of ids; a crowded range is dealt into parts by the records' archived
    ids, so that a part stays near ``SEGMENT`` records however page ids are
    spread. Replicas agree on a segment's number of parts, by the larger of their
    counts; everything else follows from a replica's own rows. Neither part, name
    nor above depends on a record's bytes or on the records beside it. Null page
    ids are ranged as -1.
    """
    known = [stored(_known(listed), "manifest") for listed in replicas]
    counts = [x.groupBy("segment").agg(F.count("*").alias("records")) for x in known]
    parts = (functools.reduce(DataFrame.unionByName, counts).groupBy("segment")
             .agg(F.ceil(F.max("records") / SEGMENT).cast("int").alias("parts")))
    order = Window.partitionBy("segment", "part").orderBy("page_id", "id")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.sha2(F.concat_ws(":", F.col("page_id").cast("string"), "id"), 256)
    return [x.join(parts, "segment")
            .withColumn("part", F.pmod(_number(F.col("id")), F.col("parts")).cast("int")).drop("parts")
            .withColumn("number", (F.row_number().over(order) - 1).cast("bigint"))
            .withColumn("start", F.sum("length").over(before) - F.col("length"))
            .withColumn("name", name).withColumn("above", F.pmod(_number(F.col("name")), F.lit(_CELLS)))
            for x in known]


_ADDRESS = ["segment", "part"]


def _node(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def leaves(records: DataFrame) -> DataFrame:
    """(segment, part, level 0, number, name, above, start, length, copies, digest,
    content). Records without a name go by their number."""
    if "name" not in records.columns:
        records = records.withColumns({"name": F.col("number").cast("string"), "above": F.floor(F.col("number") / FANOUT)})
    if "copies" not in records.columns:
        records = records.withColumn("copies", F.lit(1).cast("bigint"))
    digest = _node(*(F.col(c) for c in ("name", "start", "length", "copies", "content")))
    return records.select(*_ADDRESS, F.lit(0).alias("level"), "number", "name", "above", "start", "length", "copies",
                          digest.alias("digest"), "content")


def parents(level: DataFrame) -> DataFrame:
    """The nodes above, of their children in order: about ``FANOUT`` records, or at
    most as many nodes."""
    child = F.struct("number", "start", "length", "digest")
    ordered = F.sort_array(F.collect_list(child))
    return (level.groupBy(*_ADDRESS, (F.col("level") + 1).alias("level"), F.col("above").alias("number"))
            .agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("copies").alias("copies"),
                 ordered.alias("children"))
            .withColumns({"name": F.col("number").cast("string"), "above": F.floor(F.col("number") / FANOUT)})
            .withColumn("digest", _node(F.col("start"), F.col("length"),
                                        F.concat_ws(",", F.transform("children", lambda c: c["digest"]))))
            .withColumn("content", F.col("digest")).drop("children"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of all segments' trees, leaves first, the roots last. The number of
    levels follows the longest segment; each level is a stored table."""
    levels = [stored(leaves(records), "leaves")]
    most = levels[0].agg(F.max("above")).first()[0] or 0
    for _ in range(1 + math.ceil(math.log(most + 1, FANOUT) - 1e-9)):
        levels.append(stored(parents(levels[-1]), "nodes"))
    return levels


def _crown(roots: DataFrame, steps: list[str]) -> list[DataFrame]:
    """The levels above all segments' roots, up to one node: each step joins up to
    ``FANOUT`` neighbouring parts of a segment, or segments; the last one all."""
    levels = [roots.select(*_ADDRESS, "digest")]
    for step in steps:
        above = [(F.lit(0).cast("bigint") if step == "all" else F.floor(F.col(c) / FANOUT).cast("bigint") if c == step
                  else F.col(c)).alias(f"_{c}") for c in _ADDRESS]
        children = F.sort_array(F.collect_list(F.struct(*_ADDRESS, "digest")))
        level = (levels[-1].select(*_ADDRESS, "digest", *above).groupBy(*(f"_{c}" for c in _ADDRESS))
                 .agg(_node(F.concat_ws(",", F.transform(children, lambda c: _node(*(c[x] for x in (*_ADDRESS, "digest"))))))
                      .alias("digest")))
        levels.append(stored(level.withColumnsRenamed({f"_{c}": c for c in _ADDRESS}), "crown"))
    return levels


def _open_segments(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(segment, part) of the roots that differ, found from the one node above all."""
    ends = ours.select(*_ADDRESS).unionByName(theirs.select(*_ADDRESS)).agg(
        F.max("part").alias("part"), F.max(F.greatest(F.abs("segment"), F.abs(F.col("segment") + 1))).alias("segment")).first()

    def count(n: int | None) -> int:
        steps = 0
        while FANOUT ** steps <= (n or 0):
            steps += 1
        return steps

    steps = ["part"] * count(ends.part) + ["segment"] * count(ends.segment) + ["all"]
    a, b = _crown(ours, steps), _crown(theirs, steps)
    open_ = None
    for depth in range(len(steps), -1, -1):
        mine, other = a[depth], b[depth]
        if open_ is not None:
            step = steps[depth]
            above = [F.lit(0).cast("bigint") if step == "all" else F.floor(F.col(c) / FANOUT).cast("bigint") if c == step
                     else F.col(c) for c in _ADDRESS]
            at = open_.select(*(F.col(c).alias(f"_{c}") for c in _ADDRESS))
            mine, other = (x.withColumns({f"_{c}": v for c, v in zip(_ADDRESS, above)})
                           .join(at, [f"_{c}" for c in _ADDRESS], "left_semi").select(*_ADDRESS, "digest") for x in (mine, other))
        met = mine.join(other.withColumnRenamed("digest", "digest2"), _ADDRESS, "full_outer")
        open_ = met.where(~F.col("digest").eqNullSafe(F.col("digest2"))).select(*_ADDRESS)
    return stored(open_, "open")


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(segment, part, name, number, status) of the records that differ.

    ``status``: *damaged* (the bytes differ), *copies* (another number of copies),
    *moved* (the same bytes elsewhere in the segment), *missing* (not in theirs) or
    *added* (only in theirs, whose number it has). Records meet by name, so one
    that is lost or gained does not change what its neighbours are compared with.
    Only children of differing nodes are compared, from one node above all segments
    downwards; replicas equal in it are done.
    """
    key = [*_ADDRESS, "name"]
    while len(ours) < len(theirs):  # a shorter tree's roots stand for themselves above
        ours = [*ours, parents(ours[-1])]
    while len(theirs) < len(ours):
        theirs = [*theirs, parents(theirs[-1])]
    open_ = None
    differing = _open_segments(ours[-1], theirs[-1])
    for mine, other in zip(reversed(ours), reversed(theirs)):
        if open_ is None:
            mine, other = (x.join(differing, _ADDRESS, "left_semi") for x in (mine, other))
        else:
            above = open_.select(*_ADDRESS, F.coalesce("number1", "number2").alias("above"))
            mine, other = (x.join(above, [*_ADDRESS, "above"], "left_semi") for x in (mine, other))
        a, b = (x.select(*key, *(F.col(c).alias(f"{c}{i}") for c in ("number", "digest", "content", "copies")))
                for i, x in ((1, mine), (2, other)))
        open_ = a.join(b, key, "full_outer").where(~F.col("digest1").eqNullSafe(F.col("digest2")))
    status = (F.when(F.col("digest2").isNull(), "missing").when(F.col("digest1").isNull(), "added")
              .when(F.col("content1") != F.col("content2"), "damaged")
              .when(F.col("copies1") != F.col("copies2"), "copies").otherwise("moved"))
    return open_.select(*key, F.coalesce("number1", "number2").alias("number"), status.alias("status"))


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of ``ours`` with its status, and those only ``theirs`` has with
    their places there: two manifests from `lay_out`."""
    key = [*_ADDRESS, "name"]
    wrong = stored(audit(tree(ours), tree(theirs)).select(*key, "status"), "differences")
    mine = ours.join(wrong.where("status <> 'added'"), key, "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    return mine.unionByName(theirs.join(wrong.where("status = 'added'"), key))


def failing(page_id: Column, raw: Column, every: int) -> Column:
    """A record's bytes as a failing store would return them: of pages whose id's
    checksum divides by ``every``, the middle byte is a ``#``, or, if it divides
    by twice that, the last five bytes are lost."""
    hit = F.crc32(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    middle = F.floor(F.octet_length(raw) / 2).cast("int")
    flipped = F.concat(F.substring(raw, F.lit(1), middle - 1), F.lit("#").cast("binary"),
                       F.substring(raw, middle + 1, F.octet_length(raw)))
    return (F.when(hit % (2 * every) == 0, F.substring(raw, F.lit(1), F.octet_length(raw) - 5))
            .when(hit % every == 0, flipped).otherwise(raw))
