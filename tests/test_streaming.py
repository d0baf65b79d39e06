"""Streams over several files, with late rows and a replayed batch."""

import datetime as dt
import os
import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import seed
from vigilia.operators.suppress import suppress
from vigilia.plans import alerts, reports, views
from vigilia.sources import CARE, layout, load_tables, read_feed, work, write_table
from vigilia.sources.tables import day_range
from vigilia.sources.work import shared_folder
from vigilia.streaming import jobs, windows

T0 = dt.datetime(2026, 3, 20)


@pytest.fixture
def feed(spark, tmp_path):
    """A directory feed; each call adds one file of pings (id, resident, hour)."""
    class Feed:
        path = str(tmp_path / "feed")
        schema = CARE["gps_ping"]

        def add(self, *rows):
            pings = spark.createDataFrame([
                (i, r, None, None, T0 + dt.timedelta(hours=h)) for i, r, h in rows],
                "id_ping long, id_residente long, latitud decimal(10,7), "
                "longitud decimal(10,7), registrado_en timestamp_ntz")
            pings = pings.withColumns({"latitud": F.lit(21).cast("decimal(10,7)"),
                                       "longitud": F.lit(0).cast("decimal(10,7)")})
            pings.coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return read_feed(spark, self.path, self.schema, files_per_trigger=1)

        out, log = str(tmp_path / "out"), str(tmp_path / "log")
    return Feed()


def test_quiet_period_across_batches(spark, feed):
    def run():
        jobs.fire_quietly(feed.stream(), ["id_residente"], "registrado_en", "id_ping", 86_400,
                          feed.out, feed.log).awaitTermination()
        return {r.id_ping for r in spark.read.parquet(feed.out).collect()}

    feed.add((1, 1, 0), (2, 1, 10), (3, 2, 5))
    assert run() == {1, 3}
    feed.add((4, 1, 23), (5, 1, 25), (6, 2, 29))
    assert run() == {1, 3, 5}
    feed.add((7, 1, 1), (8, 2, 30), (9, 3, 0))  # 7 is late: silent
    assert run() == {1, 3, 5, 8, 9}
    everything = spark.read.schema(feed.schema).parquet(feed.path)
    batch = suppress(everything, ["id_residente"], "registrado_en", "id_ping", 86_400)
    assert {r.id_ping for r in batch.collect()} == {1, 3, 5, 8, 9}


def test_alert_state_is_folded_and_earlier_batches_are_not_read(spark, feed):
    r = random.Random(4)
    rows = [(i, r.choice([1, 1, 1, 2, 3, 40 + i]), 3 * i + r.randint(0, 2)) for i in range(60)]

    def run(some):
        for i in range(0, len(some), 6):
            feed.add(*some[i:i + 6])
        jobs.fire_quietly(feed.stream(), ["id_residente"], "registrado_en", "id_ping", 86_400,
                          feed.out, feed.log, fold=3).awaitTermination()

    run(rows[:48])
    held = [{x.id_residente for x in spark.read.parquet(f"{feed.out}/_latest/batch={b}").collect()} for b in range(8)]
    fired = [{x.id_residente for x in spark.read.parquet(f"{feed.out}/batch={b}").collect()} for b in range(8)]
    for b in range(8):
        assert held[b] == (set().union(*fired[:b + 1]) if b % 3 == 0 else fired[b])
    # What a batch before the last fold says now changes nothing.
    spark.createDataFrame([(k, T0 + dt.timedelta(days=99)) for k in range(4)],
                          "id_residente long, registrado_en timestamp_ntz").write.mode("overwrite").parquet(
        f"{feed.out}/_latest/batch=2")
    run(rows[48:])
    everything = spark.read.schema(feed.schema).parquet(feed.path)
    want = suppress(everything, ["id_residente"], "registrado_en", "id_ping", 86_400)
    assert {x.id_ping for x in spark.read.parquet(feed.out).collect()} == {x.id_ping for x in want.collect()}


def test_closing_reopens_the_gate(spark, feed):
    closed = spark.createDataFrame([(1, T0 + dt.timedelta(hours=5))],
                                   "id_residente long, registrado_en timestamp_ntz")
    for rows in ([(1, 1, 0)], [(2, 1, 4)], [(3, 1, 10)], [(4, 1, 12)]):
        feed.add(*rows)
        jobs.fire_quietly(feed.stream(), ["id_residente"], "registrado_en", "id_ping", 86_400,
                          feed.out, feed.log, closed=lambda: closed).awaitTermination()
    assert {r.id_ping for r in spark.read.parquet(feed.out).collect()} == {1, 3}


def test_a_replayed_batch_changes_nothing(spark, feed, tmp_path):
    feed.add((1, 1, 0), (2, 1, 30))
    feed.add((3, 1, 40), (4, 1, 60))
    for log in ("log-a", "log-b"):  # a fresh checkpoint replays both batches
        jobs.fire_quietly(feed.stream(), ["id_residente"], "registrado_en", "id_ping", 86_400,
                          feed.out, str(tmp_path / log)).awaitTermination()
        assert {r.id_ping for r in spark.read.parquet(feed.out).collect()} == {1, 2, 4}


def test_latest_position(spark, feed):
    feed.add((1, 1, 0), (2, 1, 5), (3, 2, 1))
    feed.add((4, 1, 3), (5, 2, 2))  # 4 is late
    query = jobs.keep_latest(feed.stream(), "id_residente", "registrado_en", "id_ping", feed.out,
                             feed.log)
    query.awaitTermination()
    assert query.lastProgress.batchId == 1
    order = ("id_residente", "registrado_en", "id_ping")
    assert {r.id_residente: r.id_ping for r in jobs.latest_rows(spark, feed.out, feed.stream().schema, *order).collect()} == {
        1: 2, 2: 5}


def test_latest_positions_write_what_a_batch_brings(spark, feed):
    want = {}
    for i in range(7):
        feed.add((10 * i, i % 3, i), (10 * i + 1, 50 + i, 40 - i))
        want |= {i % 3: 10 * i, 50 + i: 10 * i + 1}
    order = ("id_residente", "registrado_en", "id_ping")
    jobs.keep_latest(feed.stream(), *order, feed.out, feed.log, fold=3).awaitTermination()
    sizes = [spark.read.parquet(f"{feed.out}/batch={b}").count() for b in range(7)]
    assert sizes[1] == sizes[2] == sizes[4] == sizes[5] == 2 and sizes[3] > 2
    got = jobs.latest_rows(spark, feed.out, feed.stream().schema, *order, fold=3)
    assert {r.id_residente: r.id_ping for r in got.collect()} == want


def test_daily_counts_hold_late_rows_and_the_open_day(spark, feed):
    feed.add((1, 1, 1), (2, 1, 2))
    feed.add((3, 1, 30))
    feed.add((6, 1, 31))
    feed.add((4, 1, 3), (5, 1, 60))  # 4 comes late, 5 opens a day
    counts = windows.daily_feed_counts({"GPS": (feed.stream(), "registrado_en")})
    query = jobs.keep_counts(counts, feed.out, feed.log)
    query.awaitTermination()
    last = spark.read.parquet(f"{feed.out}/batch={query.lastProgress.batchId}")
    got = {r.desde: r.total for r in last.collect()}
    assert got == {T0: 3, T0 + dt.timedelta(days=1): 2, T0 + dt.timedelta(days=2): 1}


def test_rolling_counts(spark, feed):
    """No row of a shuffled feed is lost, however late; a replay adds none."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 2), rng.randint(0, 300) / 2) for i in range(90)] + [(99, 1, 400)]
    rng.shuffle(rows)
    for i in range(0, len(rows), 25):
        feed.add(*rows[i:i + 25])
    for log in (feed.log, feed.log + "-again"):
        jobs.keep_panes(feed.stream(), "id_residente", "registrado_en", 7_200, feed.out, log).awaitTermination()
    counts = windows.rolling_counts(spark.read.parquet(feed.out), "id_residente", 36_000, 7_200)
    got = {(r.id_residente, r.hasta): r.total for r in counts.collect()}
    want = {}
    for _, key, hour in rows:
        for end in range(2 * int(hour // 2) + 2, 2 * int(hour // 2) + 12, 2):
            at = (key, T0 + dt.timedelta(hours=end))
            want[at] = want.get(at, 0) + 1
    assert got == want


def test_alerts_and_audit_leave_no_orphans(spark, feed, tmp_path):
    """A batch that breaks between its outputs counts neither, and counts once run again."""
    audit, broken = str(tmp_path / "audit"), [True]

    def first(fired):
        return fired.select("id_ping")

    def second(fired):
        if broken and fired.where("id_ping = 2").count():
            broken.clear()
            raise RuntimeError("the second output breaks")
        return fired.select("id_ping")

    feed.add((1, 1, 0))
    feed.add((2, 2, 5), (3, 2, 6))
    other = str(tmp_path / "other")

    def run():
        jobs.fire_quietly(feed.stream(), ["id_residente"], "registrado_en", "id_ping", 86_400, feed.out, feed.log,
                          also={audit: first, other: second}).awaitTermination()

    def read(folder):
        schema = StructType([StructField("id_ping", LongType())])
        return {r.id_ping for r in jobs.batch_output(spark, folder, schema, feed.out, feed.stream().schema).collect()}

    with pytest.raises(Exception):
        run()
    assert spark.read.parquet(f"{audit}/batch=1").count() == 1 and read(audit) == read(other) == {1}
    run()
    assert read(audit) == read(other) == {1, 2}


def test_rules_run_on_streams(spark, feed):
    t = seed.tables(spark)
    feed.add((1, 3, 1), (2, 4, 2))
    jobs.append_to(alerts.geofence_incidents(feed.stream(), t), feed.out,
                   feed.log).awaitTermination()
    assert {(r.id_residente, r.id_staff, r.severidad)
            for r in spark.read.parquet(feed.out).collect()} == {(3, 4, "Alta"), (4, 1, "Alta")}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_tables_round_trip(spark, tmp_path, fmt):
    t = seed.tables(spark)
    names = ("gps_ping", "residente", "horario_medicamento")
    for name in names:
        write_table(t[name], str(tmp_path / name), name, fmt)
    back = load_tables(spark, str(tmp_path), CARE, names, fmt)
    for name in names:
        assert back[name].columns == t[name].columns
        assert sorted(map(str, back[name].collect())) == sorted(map(str, t[name].collect()))


def test_event_tables_are_laid_out_by_day(spark, tmp_path):
    name = "checkin_estado_animo"
    original = seed.tables(spark)[name]
    write_table(original, str(tmp_path / name), name)

    def load(first=None, last=None):
        return load_tables(spark, str(tmp_path), CARE, [name], first_day=first, last_day=last)[name]

    assert load().columns == original.columns and load().count() == original.count()
    one = load("2026-03-21", "2026-03-21")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(dia" in one._jdf.queryExecution().toString()
    assert day_range(original, "2026-03-21").count() == original.count()


def test_time_filters_prune_day_folders(spark, tmp_path):
    """The reports' own filters reach the folders, with no span given, and change no row."""
    t = seed.tables(spark)
    for name in ("checkin_estado_animo", "acceso_rfid", "staff", "lector_rfid", "ala"):
        write_table(t[name], str(tmp_path / name), name)
    laid_out = load_tables(spark, str(tmp_path), CARE, ["checkin_estado_animo", "acceso_rfid", "staff", "lector_rfid", "ala"])
    for report in (lambda x: reports.global_mood(x, seed.AS_OF, 2), lambda x: views.rfid_today(x, seed.AS_OF),
                   lambda x: layout.rows_in_week(x["checkin_estado_animo"], "fecha_registro", "2026-03-16")):
        got, want = report(laid_out), report(t)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "PartitionFilters: [isnotnull(dia" in got._jdf.queryExecution().toString()
        assert want.count() > 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_removes_what_was_begun_inside(spark):
    kept = work.new_folder(spark, "kept")
    spark.range(3).write.parquet(kept)
    with pytest.raises(KeyError), work.scratch(spark):
        inside = work.written(spark.range(5), "inside")
        files = [f.removeprefix("file:") for f in inside.inputFiles()]
        assert inside.count() == 5 and all(os.path.exists(f) for f in files)
        raise KeyError
    assert not any(os.path.exists(os.path.dirname(f)) for f in files)
    assert spark.read.parquet(kept).count() == 3


def test_an_application_leaves_no_intermediate_tables(tmp_path):
    code = ("from pyspark.sql import SparkSession; from vigilia.sources.work import written;"
            f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '{tmp_path}').getOrCreate();"
            "print('rows', written(s.range(7), 'x').count())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert "rows 7" in done.stdout
    for _ in range(100):  # the JVM ends a little after the driver's Python
        if not list(tmp_path.glob("*/x-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("*/x-*"))
