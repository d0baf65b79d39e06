import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilia.functions.clock import epoch_micros
from vigilia.operators import overlap, ranges, ranking, sequence
from vigilia.operators.numbering import dense_ids
from vigilia.operators.rounds import accept_in_order, first_blocks, linked_groups
from vigilia.operators.suppress import KEEP, NEVER, _hand_down, _merge, _step_function, suppress

T0 = dt.datetime(2024, 1, 1)


def make_events(seed, n=400, hot=0.4, span_hours=240, unit_seconds=1):
    """Rows (id, k, ts, v); key 0 holds ``hot`` of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randint(1, 5)
        ts = T0 + dt.timedelta(seconds=unit_seconds * rng.randint(0, span_hours * 3600 // unit_seconds))
        rows.append((i, key, ts, rng.choice([None, rng.randint(0, 9)])))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    rows = make_events(1)
    return rows, spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v int")


def test_latest_and_top_k(spark, events):
    rows, df = events
    got = {(r.k, r.id) for r in ranking.top_k_per_key(
        df, ["k"], [F.col("ts").desc(), F.col("id").desc()], 3).collect()}
    want = set()
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]), reverse=True)
        want |= {(key, r[0]) for r in mine[:3]}
    assert got == want
    latest = {r.k: r.id for r in ranking.latest_per_key(df, ["k"], "ts", "id").collect()}
    by_max = {r.k: r.m for r in df.groupBy("k").agg(
        F.max_by("id", F.struct("ts", "id")).alias("m")).collect()}
    assert latest == by_max


def test_top_k_cuts_before_the_shuffle(spark, events):
    plan = ranking.latest_per_key(events[1], ["k"], "ts", "id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("step", [-1, 1])
@pytest.mark.parametrize("hot", [0.4, 0.97, 1.0])
def test_shifted_equals_plain_window(spark, step, hot):
    rows = make_events(1, hot=hot, span_hours=1 if hot > 0.9 else 240)  # one key in one hour
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v int")
    got = {r.id: r.o for r in sequence.shifted(df, ["k"], "ts", "id", "v", "o", step).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(mine):
            j = i + step
            want[r[0]] = mine[j][3] if 0 <= j < len(mine) else None
    assert got == want


@pytest.mark.parametrize("hot", [0.4, 0.97])
def test_asof_join(spark, hot):
    rows = make_events(1, hot=hot, span_hours=2 if hot > 0.9 else 240)
    lefts = make_events(2, n=200, hot=hot, span_hours=3)
    left = spark.createDataFrame(lefts, "lid long, k long, lts timestamp_ntz, lv int")
    right = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v int")
    got = {r.lid: (r.id, r.v) for r in sequence.asof_join(
        left, right, ["k"], "lts", "ts", "id", ["id", "v"]).collect()}
    want = {}
    for lid, key, ts, _v in lefts:
        past = [r for r in rows if r[1] == key and r[2] <= ts]
        best = max(past, key=lambda r: (r[2], r[0]), default=None)
        want[lid] = (best[0], best[3]) if best else (None, None)
    assert got == want


@pytest.mark.parametrize("wrap", [True, False])
def test_nearest_daily(spark, wrap):
    rng = random.Random(3)
    scans = [(i, rng.randint(0, 3), rng.choice([rng.randrange(86400), 300, 86100, 7200]) + rng.choice([0.0, 0.5]))
             for i in range(300)]
    slots = [(i, rng.randint(0, 2), rng.randrange(0, 86400, 900)) for i in range(25)]
    got = {r.sid: r.slot_id for r in sequence.nearest_daily(
        spark.createDataFrame(scans, "sid long, k long, sec double"),
        spark.createDataFrame(slots, "slot_id long, k long, at int"),
        "k", "sec", "at", "slot_id", 7200, wrap).collect()}
    want = {}
    for sid, key, sec in scans:
        best = None
        for slot_id, slot_key, at in slots:
            gap = abs(sec - at)
            gap = min(gap, 86400 - gap) if wrap else gap
            if slot_key == key and gap <= 7200 and (best is None or (gap, slot_id) < best):
                best = (gap, slot_id)
        want[sid] = best[1] if best else None
    assert got == want


def intervals(seed, n, minutes_step=1, seconds=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = T0 + dt.timedelta(minutes=minutes_step * rng.randint(0, 4 * 1440 // minutes_step),
                                  seconds=seconds * rng.random())
        out.append((i, 0 if rng.random() < 0.4 else rng.randint(1, 3), start,
                    start + dt.timedelta(minutes=rng.choice([1, 15, 45, 60, 480]))))
    return out


@pytest.mark.parametrize("seconds,unit", [(0, 60_000_000), (59, 1)])
def test_overlap_counts(spark, seconds, unit):
    asked, stored = intervals(4, 120, 5, seconds), intervals(5, 200, 5, seconds)
    schema = "id long, res long, s timestamp_ntz, e timestamp_ntz"
    a, b = spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema)
    assert overlap.time_unit(a.unionByName(b), "s", "e") == unit
    got = {r.id: r.n for r in overlap.overlap_counts(
        a, b, "id", {"n": "res"}, "s", "e").collect()}
    assert got == {i: sum(r == r2 and s2 < e and e2 > s for _, r2, s2, e2 in stored)
                   for i, r, s, e in asked}
    first = {r.id: r.n for r in overlap.earliest_among(
        a, b, "id", "res", "s", "e", "n", unit, 480).collect()}
    assert first == {i: min(hits) for i, r, s, e in asked if (
        hits := [j for j, r2, s2, e2 in stored if r == r2 and s2 < e and e2 > s])}


def test_linked_groups(spark):
    """A long chain in key order, a star, two keys apart, and repeated links."""
    links = [(i, f"c{j}") for i in range(200) for j in (i, i + 1)] + [(500 + i, "star") for i in range(9)]
    links += [(900, "x"), (901, "y"), (901, "y")]
    got = {r.id: r._group for r in linked_groups(
        spark.createDataFrame(links, "id long, _place string"), "id").collect()}
    assert got == {i: 0 for i in range(200)} | {500 + i: 500 for i in range(9)} | {900: 900, 901: 901}


def rule():
    """A function made here is sent to workers by value."""
    def first_come(rows):
        want = []
        for i, r, s, e in rows:
            if not any(r == r2 and s2 < e and e2 > s for _, r2, s2, e2 in want):
                want.append((i, r, s, e))
        return {w[0] for w in want}
    return first_come


first_come = rule()


def accepted(spark, rows, block):
    decide = rule()
    df = spark.createDataFrame(rows, "id long, res long, s timestamp_ntz, e timestamp_ntz")

    def places(pending):
        hours = [F.floor(epoch_micros(F.col(c)) / F.lit(3_600_000_000)) for c in ("s", "e")]
        return pending.select("id", "res", F.explode(F.sequence(*hours)).alias("hour")).select(
            "id", F.struct("res", "hour").alias("_place"))

    def blocked(rest, taken):
        return overlap.overlap_counts(rest, taken, "id", {"n": "res"}, "s", "e").where("n > 0").select("id")

    def one_by_one(pdf):
        assert len(pdf) <= block and pdf["id"].is_monotonic_increasing
        return sorted(decide(pdf[["id", "res", "s", "e"]].itertuples(index=False)))

    return {r.id for r in accept_in_order(df, "id", places, blocked, one_by_one, block).collect()}


@pytest.mark.parametrize("block", [8, 40, 1_000])
def test_first_come_rounds(spark, block):
    rows = intervals(6, 150, 5)
    assert accepted(spark, rows, block) == first_come(rows)


@pytest.mark.parametrize("step", [1, -1])
def test_first_come_chain(spark, step):
    """One resource, each request in the way of the next: in key order, and against it."""
    rows = [(i, 1, T0 + dt.timedelta(minutes=40 * i), T0 + dt.timedelta(minutes=40 * i + 50)) for i in range(600)[::step]]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    assert accepted(spark, rows, 250) == first_come(rows) == set(range(0, 600, 2))


def test_first_blocks(spark):
    """Lowest keys only, groups within the block, and no earlier linked key left out."""
    links = [(i, f"c{j}") for i in range(100) for j in (i, i + 1)] + [(200 + 7 * i, "star") for i in range(30)] + [(900, "x")]
    got = {r.id: r._group for r in first_blocks(
        spark.createDataFrame(links, "id long, _place string"), "id", 16).collect()}
    chain, star = sorted(i for i in got if i < 100), sorted(i for i in got if 200 <= i < 900)
    assert chain == list(range(len(chain))) and 1 <= len(chain) <= 16 and {got[i] for i in chain} == {0}
    assert star == [200 + 7 * i for i in range(len(star))] and 1 <= len(star) <= 16
    assert got[900] == 900


def fold(rows, quiet, closed=(), carry=None):
    """One-by-one reference for `suppress`: rows (id, key, ts)."""
    fired, active = [], {k: [t] for k, t in (carry or {}).items()}
    timeline = [(t, 0, -1, k) for k, t in closed] + [(t, 1, i, k) for i, k, t in rows]
    for t, kind, i, k in sorted(timeline):
        if kind == 0:
            active[k] = [a for a in active.get(k, []) if a >= t]
        elif not any(a >= t - quiet for a in active.get(k, [])):
            fired.append(i)
            active.setdefault(k, []).append(t)
    return set(fired)


@pytest.mark.parametrize("seed,hot,closings,carried", [
    (7, 0.4, 0, True), (8, 0.9, 0, True), (9, 0.4, 25, False), (10, 0.9, 60, True), (11, 0.5, 200, False)])
def test_suppress_equals_the_fold(spark, seed, hot, closings, carried):
    rows = [(i, k, ts) for i, k, ts, _ in make_events(seed, 500, hot, 400, 600)]
    rng = random.Random(seed)
    closed = [(rng.randint(0, 5), T0 + dt.timedelta(seconds=600 * rng.randint(0, 2400)))
              for _ in range(closings)]
    carry = {0: T0 + dt.timedelta(hours=3), 2: T0 - dt.timedelta(hours=23)} if carried else None
    schema = "k long, ts timestamp_ntz"
    fired = suppress(
        spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz"), ["k"], "ts", "id", 86400,
        closed=spark.createDataFrame(closed, schema) if closed else None,
        carry=spark.createDataFrame(list(carry.items()), schema) if carry else None)
    assert {r.id for r in fired.collect()} == fold(rows, dt.timedelta(days=1), closed, carry)


@pytest.mark.parametrize("every,quiet", [(600, 7200), (600, 86400), (7, 7200)])
def test_suppress_of_a_regular_feed_in_many_ranges(spark, every, quiet):
    """One key, more ranges than are merged in one task; equal instants and ties."""
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    rows = [(i, 1, T0 + dt.timedelta(seconds=every * (i // 2))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz").withColumn("tie", F.lit(0))
    try:
        fired = suppress(df, ["k"], "ts", "tie", quiet)
        assert {r.id for r in fired.collect()} == fold(rows, dt.timedelta(seconds=quiet), [], None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sums(spark):
    """Keys of any size, null keys too; one key lies in several ranges."""
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]) if i < 500 else i, rng.randint(0, 200), i, rng.choice([None, 1, 2]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    want = {}
    for key in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]), 1):
            total += r[3] or 0
            want[r[2]] = (n, total)
    got = ranges.running(df, ["k"], ["t", "id"], {"n": F.lit(1), "s": F.coalesce("v", F.lit(0))})
    assert {r.id: (r.n, r.s) for r in got.collect()} == want
    dealt = ranges.by_ranges(df, ["k"], ["t", "id"]).where("k = 1")
    assert dealt.select(ranges.RANGE).distinct().count() > 1


def test_a_crowded_room_day_lies_in_several_ranges(spark):
    day = [(i, 1, T0 + dt.timedelta(seconds=7 * i), T0 + dt.timedelta(seconds=7 * i + 100)) for i in range(2_000)]
    df = spark.createDataFrame(day, "id long, res long, s timestamp_ntz, e timestamp_ntz")
    got = {r.id: r.n for r in overlap.overlap_counts(df.where("id % 50 = 0"), df, "id", {"n": "res"}, "s", "e").collect()}
    assert got == {i: sum(s2 < e and e2 > s for _, _, s2, e2 in day) for i, _, s, e in day if i % 50 == 0}


def test_merged_steps_equal_one_after_the_other():
    """Merged functions of neighbouring chunks give the same exits and stay short."""
    rng, second = np.random.default_rng(5), 1_000_000
    for gap, jitter in ((900 * second, 0), (900 * second, 5), (40 * second, 3)):
        us = np.sort(np.arange(4000) * 10 + rng.integers(0, jitter + 1, 4000)) * second
        reset = rng.random(4000) < 0.002
        steps = pd.concat([_step_function(pd.DataFrame(
            {"k": 1, "_chunk": c, "_entry": NEVER, "_us": us[c * 250:(c + 1) * 250],
             "_reset": reset[c * 250:(c + 1) * 250]}), ["k"], gap) for c in range(16)])
        merged = _merge(steps.assign(_group=0), ["k"])
        assert len(merged) <= gap // (10 * second) + 250
        for entry in (NEVER, -1, -5 * second, -gap // 2, -gap, -2 * gap):
            down = _hand_down(steps.assign(_group=0, _entry=entry), ["k"])
            last = _hand_down(steps[steps["_chunk"] == 15].assign(_group=0, _entry=down["_entry"].iloc[-1])
                              .pipe(lambda x: pd.concat([x, x.assign(_chunk=16)])), ["k"])["_entry"].iloc[-1]
            leave = merged["_exit"].iloc[int(np.searchsorted(merged["_upto"], entry))]
            assert last == (entry if leave == KEEP else leave)


def test_suppress_boundaries(spark):
    hours = [0, 10, 23, 24, 25]
    rows = [(i, 1, T0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    fired = suppress(df, ["k"], "ts", "id", 86400)
    assert {r.id for r in fired.collect()} == {0, 4}
    closed = spark.createDataFrame([(1, T0 + dt.timedelta(hours=5))], "k long, ts timestamp_ntz")
    fired = suppress(df, ["k"], "ts", "id", 86400, closed=closed)
    assert {r.id for r in fired.collect()} == {0, 1}


def test_dense_ids(spark):
    orders = [i * 7 for i in range(50)] + [10**15 * i for i in range(1, 50)]
    df = spark.createDataFrame([(c,) for c in orders], "c long")
    got = {r.c: r.n for r in dense_ids(df, "c", "n", F.lit(100)).collect()}
    assert got == {c: 101 + i for i, c in enumerate(orders)}


def test_long_and_backward_intervals(spark):
    schema = "id long, res long, s timestamp_ntz, e timestamp_ntz"
    day = dt.timedelta(days=1)
    stored = spark.createDataFrame([(1, 1, T0, T0 + 40 * day), (2, 1, T0 + 9 * day, T0 + 8 * day)], schema)
    asked = spark.createDataFrame([(7, 1, T0 + 30 * day, T0 + 31 * day), (8, 1, T0 + 9 * day, T0 + 5 * day),
                                   (9, 2, T0, T0 + day)], schema)
    got = {r.id: r.n for r in overlap.overlap_counts(asked, stored, "id", {"n": "res"}, "s", "e").collect()}
    assert got == {7: 1, 8: 0, 9: 0}


def test_shares_pivot_counts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "g string, c string")
    assert {(r.g, r.c): (r.n, r.p) for r in ranking.share_within(df, ["g"], ["c"], "n", "p").collect()} == {
        ("a", "x"): (2, 66.7), ("a", "y"): (1, 33.3), ("b", "y"): (1, 100.0)}
    assert {r.g: (r.x, r.y, r.z) for r in ranking.pivot_counts(df, "g", "c", ["x", "y", "z"]).collect()} == {
        "a": (2, 1, 0), "b": (0, 1, 0)}
    assert {r.c: r.total for r in ranking.counts_by(df, "c", ["x", "z"]).collect()} == {"x": 2, "z": 0}
    head = ranking.head_and_rest(df, [F.col("g"), F.col("c")], 3).collect()
    assert len(head) == 3 and {r.restantes for r in head} == {1}
