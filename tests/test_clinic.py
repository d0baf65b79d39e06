"""Small hand-made cases of the clinical analytics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilia.functions import clock, values as v
from vigilia.plans import alerts, clinic as q
from vigilia.sources.schemas import CLINIC

AS_OF = "2026-03-21 18:00:00"
NOW = dt.datetime(2026, 3, 21, 18)


def make(spark, **tables):
    out = {n: spark.createDataFrame([], ddl) for n, ddl in CLINIC.items()}
    for name, rows in tables.items():
        out[name] = spark.createDataFrame(rows, CLINIC[name])
    return out


def patients(*ids):
    return [(i, "N", f"P{i}", "Dx", None, dt.datetime(2026, 3, 1)) for i in ids]


def session(i, patient, ts, minutes=45, staff=1):
    return (i, patient, staff, ts, minutes, 3, 6)


def test_clock_and_numbers(spark):
    row = spark.range(1).select(
        clock.whole_days(clock.at("2026-03-20 06:00:00"), clock.at(AS_OF)).alias("days"),
        clock.age_years(F.lit("2000-02-29").cast("date"), "2023-02-28").alias("age"),
        v.rounded_int(F.lit(2.5)).alias("up"),
        v.whole_percent(F.lit(29), F.lit(100)).alias("cut"),
        v.whole_percent(F.lit(0), F.lit(0)).alias("none"),
        v.mood_label(F.lit(5)).alias("label"),
        clock.week_start("2026-03-21").alias("monday")).first()
    assert tuple(row) == (1, 22, 3, 28, 0, "Excelente", dt.date(2026, 3, 16))


def test_zone_must_be_utc(spark):
    clock.require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "America/Monterrey")
    try:
        with pytest.raises(ValueError):
            clock.require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_regularity_and_lapse(spark):
    t = make(spark, paciente=patients(1, 2, 3), sesion_psicologica=[
        session(1, 2, dt.datetime(2026, 3, 20, 6)), session(2, 3, dt.datetime(2026, 1, 1)),
        session(3, 3, dt.datetime(2026, 1, 11))])
    got = [(r.id_paciente, r.total_sesiones, r.dias_promedio_entre_sesiones, r.dias_sin_sesion)
           for r in q.visit_regularity(t, AS_OF).collect()]
    assert got == [(1, 0, None, None), (3, 2, 10.0, 69), (2, 1, None, 1)]
    assert [r.id_paciente for r in q.lapsed_patients(t, AS_OF).collect()] == [1, 3]


def test_fan_out_sums(spark):
    scales = [(i, 1, 1, s, "E", dt.datetime(2026, 3, 1), 5, "Leve") for i, s in ((1, 1), (2, 1), (3, 1))]
    t = make(spark, paciente=patients(1), profesional=[(1, "A", "B", "x", 1, True)],
             rol=[(1, "r")], aplicacion_escala=scales, sesion_psicologica=[
                 session(1, 1, dt.datetime(2026, 3, 2), 30), session(2, 1, dt.datetime(2026, 3, 3), 60)])
    row = q.workload(t).first()
    assert (row.minutos_totales, row.duracion_promedio_min, row.escalas_aplicadas) == (270, 45.0, 3)
    assert q.workload(t, dedup=True).first().minutos_totales == 90
    month = q.monthly_kpis(t).first()
    assert (month.mes, month.minutos_atencion, month.nuevos_pacientes) == ("2026-03", 150, 1)
    assert q.monthly_kpis(t, dedup=True).first().minutos_atencion == 90
    report = q.monthly_report(t, AS_OF).first()
    assert (report.total_sesiones, report.minutos_atencion, report.tasa_resolucion) == (2, 90, None)


def test_zone_stay_rounds(spark):
    at = dt.datetime(2026, 3, 21, 8)
    t = make(spark, paciente=patients(1), zona=[(1, "Sala")], evento_nfc=[
        (1, 1, at, "Entrada"), (1, 1, at + dt.timedelta(seconds=60), "Salida"),
        (1, 1, at + dt.timedelta(seconds=150), "Entrada")])
    row = q.zone_stay(t).first()
    assert (row.total_visitas, row.minutos_promedio_estancia, row.max_estancia_min) == (1, 2.5, 3)
    assert q.zone_stay(t, paired=True).first().minutos_promedio_estancia == 1.0


def test_silent_devices(spark):
    seen = [None, NOW - dt.timedelta(hours=7), NOW - dt.timedelta(hours=25), NOW]
    t = make(spark, dispositivo_iot=[(i, "GPS", "h", "Activo", None, s) for i, s in enumerate(seen)])
    assert [(r.id_dispositivo, r.estado_conexion) for r in q.silent_devices(t, AS_OF).collect()] == [
        (0, "OK"), (2, "CRITICO"), (1, "ADVERTENCIA")]


def test_adherence(spark):
    t = make(spark, paciente=patients(1, 2, 3), sesion_psicologica=[
        session(1, 1, dt.datetime(2026, 3, 1)), session(2, 1, dt.datetime(2026, 3, 31)),
        session(3, 2, dt.datetime(2026, 3, 31, 10))])
    got = {r.id_paciente: (r.sesiones_realizadas, r.indice_adherencia, r.clasificacion)
           for r in q.adherence_index(t, "2026-03-01", "2026-03-31", 3).collect()}
    assert got == {1: (2, 66.7, "Media"), 2: (0, 0.0, "Nula"), 3: (0, 0.0, "Nula")}
    none = q.adherence_index(t, "2026-03-01", "2026-03-31", 0).first()
    assert (none.indice_adherencia, none.clasificacion) == (100.0, "Alta")


def test_assessment_alerts(spark):
    at = dt.datetime(2026, 3, 20)
    rows = [(i, 1, 1, None, "GDS-15", at + dt.timedelta(hours=h), 9, level)
            for i, (h, level) in enumerate([(0, "Grave"), (10, "Moderado"), (23, "Grave"),
                                            (25, "Grave"), (26, "Leve")])]
    t = make(spark, aplicacion_escala=rows)["aplicacion_escala"]
    fired = {r.id_aplicacion: r for r in alerts.assessment_alerts(t).collect()}
    assert set(fired) == {0, 3}
    assert fired[0].tipo_alerta == "Evaluación GDS-15: Riesgo Grave"
    assert fired[0].descripcion == "Generada automáticamente. Puntaje: 9"
    closed = spark.createDataFrame([(1, "GDS-15", at + dt.timedelta(hours=5))],
                                   "id_paciente long, id_escala string, fecha_aplicacion timestamp_ntz")
    assert {r.id_aplicacion for r in alerts.assessment_alerts(t, closed).collect()} == {0, 1}


def test_zone_exits_link_the_latest_assessment(spark):
    at = dt.datetime(2026, 3, 20)
    gps = [(1, 1, None, None, at + dt.timedelta(minutes=m), False) for m in (0, 60, 121)]
    t = make(spark, evento_gps=gps, aplicacion_escala=[
        (5, 1, 1, None, "E", at - dt.timedelta(days=90), 1, "Leve"),
        (6, 1, 1, None, "E", at + dt.timedelta(minutes=90), 1, "Leve")])
    got = [(r.fecha_generacion, r.id_aplicacion) for r in alerts.zone_exit_alerts(
        t["evento_gps"], t).orderBy("fecha_generacion").collect()]
    assert got == [(at, 5), (at + dt.timedelta(minutes=121), 6)]
    assert alerts.zone_exit_audit(alerts.zone_exit_alerts(t["evento_gps"], t), 3).count() == 2


def test_empty_tables(spark):
    t = make(spark)
    for df in (q.mood_trend(t), q.score_change(t), q.unattended_severe_alerts(t, AS_OF),
               q.workload(t), q.alert_resolution(t), q.diagnosis_severity(t), q.monthly_kpis(t),
               q.feed_summary(t, AS_OF), q.zone_stay(t), q.scale_distribution(t),
               q.audit_activity(t), q.out_of_zone(t, AS_OF)):
        assert df.collect() == []
    assert q.monthly_report(t, AS_OF).first().total_sesiones == 0
