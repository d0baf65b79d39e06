"""The streaming jobs run to the end of the event feed."""

from __future__ import annotations

from checks import care_checks, clinic_checks
from checks.star import CARE, CLINIC, Derived, care, clinic, with_tables
from vigilia.plans import alerts
from vigilia.sources.work import new_folder
from vigilia.streaming import jobs, windows

QUIET = 7_200


def _appended(spark, stream):
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    jobs.append_to(stream, out, log).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _live(spark, sf_dir, definitions=CARE):
    return Derived(spark, sf_dir, definitions, live=True)


def _low_mood(spark, sf_dir):
    return _appended(spark, alerts.low_mood_incidents(
        _live(spark, sf_dir)["checkin_estado_animo"]))


def _geofence(spark, sf_dir):
    return _appended(spark, alerts.geofence_incidents(
        _live(spark, sf_dir)["gps_ping"], care(spark, sf_dir)))


def _restricted(spark, sf_dir):
    return _appended(spark, alerts.restricted_access_audit(
        _live(spark, sf_dir)["acceso_rfid"], care(spark, sf_dir)))


def _daily(spark, sf_dir):
    t = _live(spark, sf_dir)
    feeds = {"GPS": (t["gps_ping"], "registrado_en"), "NFC": (t["nfc_evento"], "escaneado_en"),
             "RFID": (t["acceso_rfid"], "accedido_en"),
             "Beacon": (t["deteccion_beacon"], "detectado_en")}
    counts = windows.daily_feed_counts(feeds)
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    query = jobs.keep_counts(counts, out, log)
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/batch={query.lastProgress.batchId}")


def _positions(spark, sf_dir):
    pings = _live(spark, sf_dir)["gps_ping"]
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    order = ("id_residente", "registrado_en", "id_ping")
    jobs.keep_latest(pings, *order, out, log).awaitTermination()
    return jobs.latest_rows(spark, out, pings.schema, *order)


HOUR = 3_600


def _rolling(spark, sf_dir):
    seen = _live(spark, sf_dir)["deteccion_beacon"]
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    jobs.keep_panes(seen, "id_beacon", "detectado_en", HOUR, out, log).awaitTermination()
    return windows.rolling_counts(spark.read.parquet(out), "id_beacon", 48 * HOUR, HOUR)


def _assessments(spark, sf_dir):
    risky = alerts.risky_assessments(_live(spark, sf_dir, CLINIC)["aplicacion_escala"])
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    jobs.fire_quietly(risky, alerts.SCALE_KEYS, "fecha_aplicacion", "id_aplicacion", alerts.DAY, out,
                      log).awaitTermination()
    return alerts.described_assessments(spark.read.schema(risky.schema).parquet(out))


def _zone_outputs(spark, sf_dir):
    """The alerts and audit rows that one stream of GPS events leaves."""
    t = clinic(spark, sf_dir)
    gps = _live(spark, sf_dir, CLINIC)["evento_gps"].where("NOT dentro_zona_segura")
    out, raised, audit, log = (new_folder(spark, f"stream-{x}") for x in ("out", "alerts", "audit", "log"))
    schemas = {}

    def kept(folder, make):
        def run(fired):
            df = make(fired)
            schemas[folder] = df.schema
            return df
        return run

    jobs.fire_quietly(
        gps, ["id_paciente"], "timestamp_evento", "id_dispositivo", QUIET, out, log, also={
            raised: kept(raised, lambda fired: alerts.linked_zone_alerts(fired, t)),
            audit: kept(audit, lambda fired: alerts.zone_exit_audit(alerts.linked_zone_alerts(fired, t)))},
    ).awaitTermination()
    return tuple(jobs.batch_output(spark, f, schemas[f], out, gps.schema) for f in (raised, audit))


def _zone_exits(spark, sf_dir):
    gps = _live(spark, sf_dir, CLINIC)["evento_gps"].where("NOT dentro_zona_segura")
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    jobs.fire_quietly(gps, ["id_paciente"], "timestamp_evento", "id_dispositivo", QUIET, out,
                      log).awaitTermination()
    return spark.read.parquet(out).select(*gps.columns)


QUERIES = {
    "stream_low_mood": _low_mood,
    "stream_geofence": _geofence,
    "stream_restricted_audit": _restricted,
    "stream_daily_counts": _daily,
    "stream_positions": _positions,
    "stream_zone_exits": _zone_exits,
    "stream_rolling_counts": _rolling,
    "stream_assessment_alerts": _assessments,
    "stream_zone_alerts": lambda s, d: _zone_outputs(s, d)[0],
    "stream_zone_audit": lambda s, d: _zone_outputs(s, d)[1],
}

ORACLES = {
    "stream_low_mood": care_checks.ORACLES["low_mood_incidents"],
    "stream_geofence": care_checks.ORACLES["geofence_alerts"],
    "stream_restricted_audit": care_checks.ORACLES["restricted_audit"],
    "stream_daily_counts": with_tables(CARE, "gps_ping nfc_evento acceso_rfid deteccion_beacon", """
, e AS (SELECT 'GPS' AS f, registrado_en AS moment FROM gps_ping
        UNION ALL SELECT 'NFC', escaneado_en FROM nfc_evento
        UNION ALL SELECT 'RFID', accedido_en FROM acceso_rfid
        UNION ALL SELECT 'Beacon', detectado_en FROM deteccion_beacon)
SELECT date_trunc('day', moment) AS desde, date_trunc('day', moment) + INTERVAL '1' DAY AS hasta,
       f AS tipo_evento, COUNT(*) AS total
FROM e WHERE moment IS NOT NULL GROUP BY ALL"""),
    "stream_rolling_counts": with_tables(CARE, "deteccion_beacon", """
, pane AS (SELECT id_beacon, date_trunc('hour', detectado_en) AS h, COUNT(*) AS n
           FROM deteccion_beacon WHERE detectado_en IS NOT NULL GROUP BY ALL)
, each AS (SELECT id_beacon, n, UNNEST(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 48 HOUR, INTERVAL 1 HOUR)) AS hasta FROM pane)
SELECT id_beacon, hasta - INTERVAL 48 HOUR AS desde, hasta, SUM(n)::BIGINT AS total FROM each GROUP BY ALL"""),
    "stream_assessment_alerts": clinic_checks.ORACLES["assessment_alerts"],
    "stream_zone_alerts": clinic_checks.ORACLES["zone_exit_alerts"],
    "stream_zone_audit": clinic_checks.ZONE_AUDIT,
    "stream_positions": with_tables(CARE, "gps_ping", care_checks.PING + " SELECT * FROM ping"),
    "stream_zone_exits": with_tables(CLINIC, "evento_gps", clinic_checks.FIRED.format(
        key="id_paciente", fkey="f.id_paciente", ts="timestamp_evento",
        columns="id_dispositivo, latitud, longitud, dentro_zona_segura", table="evento_gps",
        condition="NOT dentro_zona_segura", hours=2, same="r.id_paciente = f.id_paciente") + """
SELECT r.id_dispositivo, r.id_paciente, r.latitud, r.longitud, r.moment AS timestamp_evento,
       r.dentro_zona_segura FROM fired JOIN risky r USING (id_paciente, moment)""",
                                     recursive=True),
}
