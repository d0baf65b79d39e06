"""A trie of conversation prefixes, by SQL ROLLUP over positional turn columns.

Every turn has an id: a digest of its role and text, with the text's bytes in
its tail. A conversation is cut into blocks of ``WIDTH`` turns, one row a block
with its turn ids in columns ``t1 ... tw``, and with the name of the node where
the block begins. One ROLLUP over the columns then aggregates all prefixes of all
blocks together, and ``grouping_id`` tells how deep a group is. A node's name is
its depth and two sums, over its turns, of 64-bit hashes of (position, id): any
block's name comes from running sums, so long conversations need no rounds of
their own, and a conversation of any length is worked on by as many tasks as it
has ranges of rows.

Subtree sums take a second ROLLUP inside blocks; what hangs below a block's last
column is brought up by doubling steps over blocks, logarithmic in the longest
conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilia.llm.tables import stored
from vigilia.operators.ranges import running

#: Turns a block holds. Each block row is expanded into as many prefixes.
WIDTH = 8
#: Ids joined into one row before the digest of a node's ids is taken.
_JOINED = 4_096
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "k1", "k2"]
_GROUP = ["block", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, tid): the turns of every conversation, numbered from 1.

    Order is turn (null first), then role, then text; equal rows all count. A null
    role or text is empty. Rows without a conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = running(rows, ["conv_id"], ["turn", "role", "text"], {"p": F.lit(1)})
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    size = F.lpad(F.hex(F.octet_length("text")), 12, "0")
    tid = F.unhex(F.concat(F.substring(F.sha2(said.cast("binary"), 256), 1, 32), size))
    return stored(rows.select("conv_id", F.col("p").cast("bigint").alias("p"), tid.alias("tid")), "turns")


def _bytes(tid: Column) -> Column:
    """The text's bytes out of a turn's id."""
    return F.conv(F.hex(F.substring(tid, 17, 6)), 16, 10).cast("bigint")


def regrafted(own: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, p, tid): every conversation with its first turns taken from the
    conversation that leads its group; a row of NULL p for each conversation.

    Conversation c takes the first h turns of c - c % ``group``, all if there are
    fewer and none if it is absent, then its own from turn h + 1 on, where h is
    crc32(decimal c) % (``most`` + 1).
    """
    c = F.col("conv_id")
    convs = own.where("p = 1").select(
        "conv_id", (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h"),
        (c - c % group).alias("base"))
    heads = own.where(F.col("p") <= most).select(F.col("conv_id").alias("base"), "p", "tid")
    taken = convs.join(heads, "base").where("p <= h").select("conv_id", "p", "tid")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    shift = convs.join(lengths, "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("held"))
    kept = own.join(shift, "conv_id").where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("held")).alias("p"), "tid")
    alone = convs.select("conv_id", F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("binary").alias("tid"))
    return stored(taken.unionByName(kept).unionByName(alone), "rebuilt")


def _name(position: Column, tid: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its position, as exact decimals."""
    return (F.xxhash64(position, tid).cast("decimal(38,0)"),
            F.xxhash64(F.lit("second"), tid, position).cast("decimal(38,0)"))


def _add(*terms: Column) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = (total + t).cast("decimal(38,0)")
    return total


def blocks(rebuilt: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, block, p1, p2, t1 ... tw, n): a row a block; ``n`` its turns."""
    slot = F.coalesce((F.col("p") - 1) % width, F.lit(-1))
    zero = F.lit(0).cast("decimal(38,0)")
    h1, h2 = _name(F.col("p"), F.col("tid"))
    rows = rebuilt.withColumns({
        "block": F.coalesce(F.floor((F.col("p") - 1) / width), F.lit(0)), "slot": slot,
        "h1": F.when(F.col("p").isNull(), zero).otherwise(h1), "h2": F.when(F.col("p").isNull(), zero).otherwise(h2)})
    rows = rows.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == j, F.col("tid"))).alias(f"t{j + 1}") for j in range(width)],
        F.count("p").alias("n"), F.sum("h1").cast("decimal(38,0)").alias("h1"), F.sum("h2").cast("decimal(38,0)").alias("h2"))
    rows = running(rows, ["conv_id"], ["block"], {"s1": F.col("h1"), "s2": F.col("h2")})
    before = [(F.col(s) - F.col(h)).cast("decimal(38,0)").alias(p) for s, h, p in (("s1", "h1", "p1"), ("s2", "h2", "p2"))]
    ends = [F.col(s).cast("decimal(38,0)").alias(s) for s in ("s1", "s2")]
    return stored(rows.select("conv_id", "block", *before, *[f"t{j + 1}" for j in range(width)], "n", *ends), "blocks")


def _rollup(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """One row for each prefix of the rows' columns: ``k``, its columns, and the measures."""
    columns = ", ".join(f"t{j + 1}" for j in range(width))
    grouped = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {columns}, {width} - bit_count(grouping_id()) AS k, {measures} "
        f"FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({columns})", rows=rows)
    # A shorter row's empty columns make groups of their own, which are no prefixes.
    last = F.coalesce(*[F.when(F.col("k") == j + 1, F.col(f"t{j + 1}").isNotNull()) for j in range(width)], F.lit(True))
    return grouped.where(last)


def _named(rows: DataFrame, width: int) -> DataFrame:
    """Names of each prefix's node (depth, k1, k2) and of its parent (_, u1, u2)."""
    at = lambda j: F.col("block") * width + j + 1
    zero = F.lit(0).cast("decimal(38,0)")
    own, above = [], []
    for which, p in enumerate(("p1", "p2")):
        each = [_name(at(j), F.col(f"t{j + 1}"))[which] for j in range(width)]
        own.append(_add(F.col(p), *[F.when(F.col("k") > j, e).otherwise(zero) for j, e in enumerate(each)]))
        above.append(_add(F.col(p), *[F.when(F.col("k") > j + 1, e).otherwise(zero) for j, e in enumerate(each)]))
    return rows.withColumns({
        "depth": (F.col("block") * width + F.col("k")).cast("bigint"),
        "k1": own[0], "k2": own[1], "u1": above[0], "u2": above[1]})


def nodes(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every node once: its name, its parent's, its place in its block, n_convs,
    smallest conv_id, and the bytes of its last text."""
    rows = _rollup(cut, width, "count(*) AS n_convs, min(conv_id) AS conv_id")
    rows = _named(rows.where("k > 0 OR block = 0"), width)
    last = F.coalesce(*[F.when(F.col("k") == j + 1, _bytes(F.col(f"t{j + 1}"))) for j in range(width)], F.lit(0))
    return stored(rows.withColumn("bytes", last), "nodes")


def _below(rows: DataFrame, width: int) -> DataFrame:
    """(block, p1, p2, leaves, saved): for each block's first node beyond the
    first block, the sums over all that hangs below it, in doubling steps."""
    within = rows.where("block > 0").groupBy(*_GROUP).agg(
        F.sum("leaf").alias("leaves"), F.sum("save").cast("decimal(38,0)").alias("saved"))
    hung = rows.where((F.col("k") == width)).select(
        (F.col("block") + 1).alias("block"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.struct("block", "p1", "p2").alias("up"))
    current = stored(within.join(hung, _GROUP), "below")
    while not current.where("up.block > 0").isEmpty():
        # What lies twice as far: the sums of those whose ancestor this is, and that ancestor's own.
        gained = current.where("up.block > 0").groupBy("up").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        gained = gained.select("up.*", "more", "most")
        upper = current.select(F.struct(*_GROUP).alias("up"), F.col("up").alias("further"))
        top = F.struct(F.lit(0).cast(current.schema["block"].dataType).alias("block"), F.col("up.p1").alias("p1"), F.col("up.p2").alias("p2"))
        current = stored(
            current.join(gained, _GROUP, "left").join(upper, "up", "left").select(
                *_GROUP, (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("most", F.lit(0))).cast("decimal(38,0)").alias("saved"),
                F.coalesce("further", top).alias("up")), "below")
    return current.select(*_GROUP, "leaves", "saved")


def _subtrees(rows: DataFrame, width: int) -> DataFrame:
    """(depth, k1, k2, n_leaves, saved_tokens) of every node."""
    below = _below(rows, width).select(
        (F.col("block") * width).cast("bigint").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "leaves", "saved")
    full = rows.join(below, _NODE, "left").withColumns({
        "leaf": F.col("leaf") + F.coalesce("leaves", F.lit(0)),
        "save": F.col("save") + F.coalesce("saved", F.lit(0))}).select(*_GROUP, *[f"t{j + 1}" for j in range(width)], "leaf", "save")
    sums = _rollup(full, width, "sum(leaf) AS n_leaves, sum(save) AS saved_tokens").where("k > 0 OR block = 0")
    return _named(sums, width).select(*_NODE, F.col("n_leaves").cast("bigint").alias("n_leaves"),
                                      F.col("saved_tokens").cast("bigint").alias("saved_tokens"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by node and id: up to ``_JOINED`` ids of a node in one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c) for c in (*_NODE, "conv_id")]
        depth, k1, k2, ids = (c.to_numpy(zero_copy_only=False) for c in key)
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        runs = np.flatnonzero(new)
        starts = np.concatenate([np.arange(a, b, _JOINED) for a, b in zip(runs, np.append(runs[1:], len(new)))])
        parts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, np.append(starts[1:], len(new)))]
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(starts)) for c in key), pa.array(parts, pa.string())],
                                         [*_NODE, "conv_id", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by node and first id: the digest of each node's ids, one node's state at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for *now, text in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if now != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _digests(done)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string()]
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [*_NODE, "ends_sha256"])


def ends(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which conversations end.

    Ids are sorted in ranges and joined in runs before a node's digest is taken,
    which by its nature reads them one after the other.
    """
    named = cut.select(
        "conv_id", "block", F.col("s1").alias("k1"), F.col("s2").alias("k2"), "n",
        (F.col("block") * width + F.col("n")).cast("bigint").alias("depth"))
    last = named.groupBy("conv_id").agg(F.max_by(F.struct(*_NODE), "block").alias("x")).select("conv_id", "x.*")
    kinds = "depth bigint, k1 decimal(38,0), k2 decimal(38,0)"
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = (last.repartitionByRange(parts, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
              .select(*_NODE, "conv_id").mapInArrow(_joined, f"{kinds}, conv_id bigint, ids string"))
    return (joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
            .mapInArrow(_digested, f"{kinds}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every node of the trie of rebuilt conversations (see `regrafted`).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the node's name (node_id). Without
    conversations there is no node; extra columns play no part.
    """
    cut = blocks(regrafted(turns(conversations)), width)
    all_nodes = nodes(cut, width)
    up = [F.col("u1").alias("k1"), F.col("u2").alias("k2")]
    children = all_nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *up).agg(F.count("*").alias("n_children"))
    marked = stored(all_nodes.join(children, _NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "leaf": F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(0).cast("bigint"),
        "save": ((F.col("n_convs") - 1) * F.col("bytes")).cast("decimal(38,0)")}), "marked")
    parents = marked.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                            F.col("conv_id").alias("parent_conv_id"))
    return (
        marked.join(parents, ["depth", "u1", "u2"], "left")
        .join(_subtrees(marked, width), _NODE).join(ends(cut, width), _NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
                F.concat_ws(":", *[F.col(c).cast("string") for c in _NODE]).alias("node_id")))
