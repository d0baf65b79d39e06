"""Near-duplicate documents by SetSketch registers.

A text's set of word shingles becomes ``m`` registers: each shingle is a Poisson
process of points dealt to the registers, a register keeps the smallest point x
it was dealt, as the exponent floor(1 - log_b x) of an exponential scale, cut to
[0, q]. Registers merge by maximum, so sketches of parts give the sketch of the
whole, and equal registers are about as likely as the sets are similar. Bands
of registers give candidates; a joint likelihood over all registers and both set
sizes dismisses the clearly different; what is left is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilia.llm import arrays
from vigilia.llm.arrays import U
from vigilia.llm.components import components
from vigilia.llm.tables import shared_ids, stored, text_key
from vigilia.operators.ranges import running

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
SCALE = 1.01
CUT = 65535
#: Registers start here so that single shingles and very large sets both fit.
_ZERO = 2000
#: A pair is dismissed if its best likelihood exceeds that of the threshold by this much (5 standard deviations).
DISMISS = 12.5
#: Members compared with one leader in one task.
_GROUP = 256
#: Classes of one block of a cluster, about; set sizes of a band lie within this ratio.
_BLOCK = 256
_BAND = 1.05


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's sorted distinct shingle hashes, one after the
    other. Fewer than ``size`` words make one shingle; no words make none."""
    data, offsets = arrays.utf8(texts)
    data = arrays.LOWER[data]
    starts, ends, first = arrays.words(data, offsets)
    h = arrays.word_hashes(data, starts, ends)
    rolled = h.copy()
    for k in range(1, size):
        rolled[:-k or None] = arrays.combine(rolled[:-k or None], h[k:])
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            sets.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            one = h[a:a + 1]
            for k in range(a + 1, b):
                one = arrays.combine(one, h[k:k + 1])
            sets.append(one + U(b - a))
        else:
            sets.append(h[:0])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate(([0], np.cumsum(sizes)))


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The registers of every set, one row of uint16 each."""
    n = len(first) - 1
    sizes = np.diff(first)
    least = np.full((n, REGISTERS), np.inf)
    owner = np.repeat(np.arange(n), sizes)
    small = sizes[owner] < 64
    for chosen, block in ((np.flatnonzero(~small), 1), (np.flatnonzero(small), 64)):
        h, own = hashes[chosen], owner[chosen]
        times = np.zeros(len(h))
        step = 0
        while len(h):
            for _ in range(block):
                # Point number ``step`` of every live shingle: an exponential gap and a register.
                r = arrays.mix(h + U((step + 1) * 0xA24BAED4963EE407 % 2**64))
                times = times - np.log(((r >> U(12)).astype(np.float64) + 0.5) / 2.0**52) / REGISTERS
                to = (arrays.mix(r ^ U(0x5851F42D4C957F2D)) % U(REGISTERS)).astype(np.int64)
                np.minimum.at(least.ravel(), own * REGISTERS + to, times)
                step += 1
            live = times < least.max(axis=1)[own]
            h, own, times = h[live], own[live], times[live]
    with np.errstate(divide="ignore"):
        exponents = np.floor(1 - np.log(least) / np.log(SCALE)) + _ZERO
    exponents[sizes == 0] = 0
    return np.clip(exponents, 0, CUT).astype(">u2")


def merged(a: bytes, b: bytes) -> bytes:
    """The sketch of a union from the sketches of its parts."""
    return np.maximum(np.frombuffer(a, ">u2"), np.frombuffer(b, ">u2")).astype(">u2").tobytes()


def _curve(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (SCALE - 1) / SCALE) / np.log(SCALE)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of register rows may reach the similarity ``least``.

    Registers above, below and equal are multinomial with chances given by the
    two set sizes and the similarity; a pair stays unless its most likely
    similarity is lower and far likelier than ``least``.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = na / (na + nb)

    def likelihood(j):
        up = np.clip(_curve(np.clip(u - (1 - u) * j, 0, 1)), 1e-9, 1)
        down = np.clip(_curve(np.clip((1 - u) - u * j, 0, 1)), 1e-9, 1)
        same = np.clip(1 - up - down, 1e-9, 1)
        return above * np.log(up) + below * np.log(down) + (REGISTERS - above - below) * np.log(same)

    bound = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.stack([likelihood(j * bound) for j in np.linspace(0, 1, 65)])
    best = grid.argmax(axis=0) / 64 * bound
    return (bound >= least) & ((best >= least) | (grid.max(axis=0) - likelihood(np.full(len(u), least)) <= DISMISS))


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole):
                hashes, first = shingle_sets(batch.column("text"), size)
                sizes = np.diff(first)
                registers = sketches(hashes, first)
                sums = [np.concatenate(([U(0)], np.cumsum(x)))
                        for x in (arrays.mix(hashes ^ U(0x1234567)), arrays.mix(hashes + U(0x89ABCDEF)))]
                one, two = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.array(one), pa.array(two),
                     pa.array([r.tobytes() for r in registers], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "registers"])
    return run


def _plausible_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS)
                        for c in ("registers", "other"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                yield batch.filter(pa.array(plausible(a, b, na, nb, least))).select(["a", "b"])
    return run


def _confirm(size: int, percent: int):
    """Rows sorted by (leader, salt, member), the leader's own row first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for whole in batches:
            for batch in arrays.slices(whole):
                hashes, first = shingle_sets(batch.column("text"), size)
                keep = []
                for i, (lead, member) in enumerate(zip(batch.column("leader").to_pylist(),
                                                       batch.column("member").to_pylist())):
                    mine = hashes[first[i]:first[i + 1]]
                    if member == lead:
                        leader, own = lead, mine.copy()
                    elif lead == leader:
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        keep.append(100 * both >= percent * (len(own) + len(mine) - both))
                        continue
                    keep.append(False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("leader"), batch.column("member")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Members and their leader meet in one sorted run of rows; a leader with many
    members is repeated for each of several salts, so no run is long.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / _GROUP).cast("int").alias("salts"))
    # Salted by the leader's count, which is joined as a column and never collected.
    members = (pairs.join(many, "a")
               .select(F.col("a").alias("leader"), F.col("b").alias("member"),
                       F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")))
    leaders = many.select(F.col("a").alias("leader"), F.col("a").alias("member"),
                          F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = members.unionByName(leaders)
    rows = asked.join(texts.select(F.col("doc_id").alias("member"), "text"), "member")
    return (rows.repartition("leader", "salt")
            .sortWithinPartitions("leader", "salt", F.col("member") != F.col("leader"), "member")
            .select("leader", "member", "text")
            .mapInArrow(_confirm(size, percent), "a bigint, b bigint"))


def _screened(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    left = sketch.select(F.col("doc_id").alias("a"), "registers", F.col("n_shingles").alias("na"))
    right = sketch.select(F.col("doc_id").alias("b"), F.col("registers").alias("other"),
                          F.col("n_shingles").alias("nb"))
    return (pairs.join(left, "a").join(right, "b")
            .mapInArrow(_plausible_pairs(least), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Links join texts whose shingle sets have 100 * |A & B| >= percent * |A | B|;
    ``component_id`` is the smallest doc_id reachable. Texts without words, null
    texts and null ids link with nothing (a null id gives a null component and
    is kept). Repeated rows are one document and are reported each.

    Equal sets fold into one class first, so copies cost nothing further. In each
    band bucket every member meets the bucket's smallest id; where members of a
    bucket are then still in different components, all of them are compared in
    blocks, with no cap. Members of one component need no more comparing.
    """
    least = percent / 100
    base = docs.select("doc_id", "text")
    described = stored(base.mapInArrow(
        _describe(size), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, registers binary"), "sketch")
    classes = (described.where("n_shingles > 0 and doc_id is not null")
               .groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("doc_id"),
                                                      F.first("registers").alias("registers")))
    classes = stored(classes, "classes")
    width = 2 * ROWS
    bands = classes.select("doc_id", F.explode(F.array(*(
        F.xxhash64(F.lit(i), F.substring("registers", 1 + i * width, width)) for i in range(BANDS)))).alias("bucket"))
    leads = bands.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    shared = stored(bands.join(leads.select("bucket", "leader"), "bucket"), "buckets")
    stars = shared.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stored(_screened(stars, classes, least), "pairs")
    # Texts of the classes that share a bucket: the only ones to be read again.
    texts = stored(base.join(shared.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "text"]), "texts")
    links = stored(_links(stars, texts, size, percent), "links")
    found = components(links)
    open_ = _open(shared, found)
    if not open_.isEmpty():
        found = components(links.unionByName(_links_across(open_, classes, texts, size, percent)))
    members = classes.select("doc_id", "n_shingles", "s1", "s2").join(
        found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "n_shingles", "s1", "s2", F.coalesce("component", "doc_id").alias("component_id"))
    linked = described.drop("registers").join(
        members, ["n_shingles", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"),
                         F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, doc_id, component) of the buckets whose members are in several components."""
    placed = shared.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    return stored(placed.join(mixed.select("bucket"), "bucket"), "open")


def _links_across(open_: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components that meet in a bucket, enough of them to join
    whatever is linked.

    Classes that meet in buckets, directly or by others, are a cluster. A cluster is
    cut into bands of set sizes and a band into blocks by the ids' hashes; two blocks
    whose sizes can still reach the threshold meet in one task, which counts all their
    intersections exactly. Rows are repeated for blocks, never for pairs of rows.
    """
    heads = open_.groupBy("bucket").agg(F.min("doc_id").alias("a"))
    clusters = components(open_.join(heads, "bucket").select("a", F.col("doc_id").alias("b")))
    members = (open_.select("doc_id", "component").distinct()
               .join(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
               .join(classes.select("doc_id", "n_shingles"), "doc_id"))
    members = members.withColumn("band", F.floor(F.log("n_shingles") / np.log(_BAND)))
    many = members.groupBy("cluster", "band").agg(F.ceil(F.count("*") / _BLOCK).alias("parts"))
    block = F.shiftleft("band", 32) + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    members = stored(members.join(many, ["cluster", "band"]).withColumn("block", block).drop("band", "parts"), "clusters")
    blocks = members.groupBy("cluster", "block").agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"),
        F.min("component").alias("c0"), F.max("component").alias("c1"))
    other = blocks.select("cluster", *(F.col(c).alias(f"{c}_") for c in ("block", "low", "high", "c0", "c1")))
    meet = (blocks.join(other, "cluster").where("block <= block_")
            .where(100 * F.col("high") >= percent * F.col("low_"))
            .where("not (c0 = c1 and c0_ = c1_ and c0 = c0_)").select("cluster", "block", "block_"))
    sides = meet.select("cluster", F.col("block").alias("one"), F.col("block_").alias("two"),
                        F.explode(F.array_distinct(F.array("block", "block_"))).alias("block"))
    rows = members.join(texts, "doc_id").join(sides, ["cluster", "block"]).select(
        "cluster", "one", "two", F.col("block").alias("own"), "doc_id", "component", "text")
    return stored(rows.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "own", "doc_id")
                  .mapInArrow(_compare(size, percent), "a bigint, b bigint"), "links")


def _compare(size: int, percent: int):
    """Rows sorted by pair of blocks, one block after the other."""
    def forest(rows) -> list[tuple[int, int]]:
        ids, component, own, sets = zip(*rows)
        top = {c: c for c in component}

        def find(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        sizes = np.array([len(s) for s in sets])
        left = np.flatnonzero(np.array(own) == min(own))
        right = np.flatnonzero(np.array(own) == max(own))
        both = _intersections(sets, left, right)
        linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        out = []
        for i, j in zip(*np.nonzero(linked)):
            a, b = left[i], right[j]
            x, y = find(component[a]), find(component[b])
            if x != y:
                top[y] = x
                out.append((ids[a], ids[b]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for whole in batches:
            for batch in arrays.slices(whole):
                hashes, first = shingle_sets(batch.column("text"), size)
                columns = [batch.column(c).to_pylist() for c in ("cluster", "one", "two", "doc_id", "component", "own")]
                for i, (*at, doc, component, own) in enumerate(zip(*columns)):
                    if at != key:
                        out += forest(rows) if rows else []
                        key, rows = at, []
                    rows.append((doc, component, own, hashes[first[i]:first[i + 1]].copy()))
        out += forest(rows) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def _intersections(sets: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, exactly:
    products of 0-1 matrices, ``width`` shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[shingle]
    owner, shingle = owner[keep], number[shingle[keep]]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    total = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(shingle, (start, start + width))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], shingle[a:b] - start] = 1
        total += held[left] @ held[right].T
    return np.rint(total).astype(np.int64)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies of a smaller id; repeated rows once.

    A document is an id with its text: texts that share an id are judged each by
    itself, and count as later than all documents whose id has one text. Null ids
    are kept. Of rows that differ in other columns only, any one is kept.
    """
    columns = docs.columns
    several = shared_ids(docs)
    keyed = docs.where("doc_id is not null").withColumn("_own", F.col("doc_id"))
    # Texts are shuffled for new ids only if an id stands for several of them.
    if not several.isEmpty():
        last = docs.agg(F.max("doc_id").alias("m")).first()[0]
        numbered = stored(running(
            several.withColumn("one", F.lit(1)), ["one"], ["doc_id", "version"], {"n": F.lit(1)}).select(
            "doc_id", "version", (F.col("n") + F.lit(last)).cast("bigint").alias("_new")), "numbered")
        keyed = (keyed.withColumn("version", text_key()).join(numbered, ["doc_id", "version"], "left")
                 .withColumn("_own", F.coalesce("_new", "doc_id")))
    kept = near_duplicates(keyed.select(F.col("_own").alias("doc_id"), "text"), size, percent)
    kept = kept.where("kept").select(F.col("doc_id").alias("_own")).distinct()
    return (keyed.join(kept, "_own").dropDuplicates(["_own", "text"]).select(*columns)
            .unionByName(docs.where("doc_id is null")))
