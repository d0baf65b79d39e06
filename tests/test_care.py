"""Golden tests: the small facility with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import seed
from seed import AS_OF, NOW, TODAY
from vigilia.operators import checks
from vigilia.plans import alerts, dims, lists, reports, views
from vigilia.sources.schemas import CARE


@pytest.fixture(scope="module")
def t(spark):
    """The facility after the alert rules ran over its rows."""
    out = seed.tables(spark)
    raised = alerts.low_mood_incidents(out["checkin_estado_animo"], raised_at=AS_OF).unionByName(
        alerts.geofence_incidents(out["gps_ping"], out, raised_at=AS_OF)).collect()
    raised.sort(key=lambda r: (r.tipo, r.severidad != "Media"))
    rows = [(i, r.id_residente, r.id_staff, r.fecha, r.tipo, r.descripcion, r.severidad)
            for i, r in enumerate(raised, 1)]
    out["reporte_incidente"] = out["reporte_incidente"].unionByName(
        spark.createDataFrame(rows, CARE["reporte_incidente"]))
    audit = sorted(alerts.restricted_access_audit(out["acceso_rfid"], out).collect(),
                   key=lambda r: r.id_registro)
    out["log_auditoria"] = spark.createDataFrame(
        [(i, r.id_usuario, r.tabla_afectada, r.operacion, r.id_registro, None,
          r.timestamp_operacion) for i, r in enumerate(audit, 1)], CARE["log_auditoria"])
    return out


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_alert_rules(t):
    raised = {(r.id_residente, r.id_staff, r.tipo, r.severidad): r.descripcion
              for r in t["reporte_incidente"].where("id_incidente <= 4").collect()}
    assert raised == {
        (1, 2, "Agitacion", "Media"):
            "Alerta automática: puntaje de ánimo bajo (2/5) registrado por cuidador.",
        (3, 4, "Agitacion", "Alta"):
            "Alerta automática: puntaje de ánimo bajo (1/5) registrado por cuidador.",
        (2, 4, "Deambulacion", "Alta"):
            "Alerta GPS: residente detectado fuera del perímetro del jardín. "
            "Coords: (40.2500000, -3.6500000).",
        (5, 1, "Deambulacion", "Alta"):  # nobody looks after 5
            "Alerta GPS: residente detectado fuera del perímetro del jardín. "
            "Coords: (40.1500000, -3.5500000)."}
    # Access 3 has no user to sign; access 1 is signed by the first active one.
    assert rows(t["log_auditoria"], "id_registro", "id_usuario") == [(1, 4), (4, 2)]


def test_geofence_edges(spark, t):
    edge = spark.createDataFrame(
        [(1, 1, "40.20", "-3.60"), (2, 1, "40.20000001", "-3.60")],
        "id_ping long, id_residente long, latitud string, longitud string"
    ).select("id_ping", "id_residente", F.col("latitud").cast("decimal(10,7)"),
             F.col("longitud").cast("decimal(10,7)"), F.lit(NOW).cast("timestamp_ntz").alias(
                 "registrado_en"))
    assert alerts.geofence_incidents(edge, t).count() == 0
    far = edge.withColumn("latitud", F.lit(21).cast("decimal(10,7)"))
    no_carer = {**t, "asignacion": t["asignacion"].where("FALSE")}
    assert {r.id_staff for r in alerts.geofence_incidents(far, no_carer).collect()} == {1}
    no_box = {**t, "limite_jardin": t["limite_jardin"].where("FALSE")}
    assert alerts.geofence_incidents(far, no_box).count() == 0


def test_views(t):
    assert rows(views.residents_summary(t, AS_OF), "residente", "edad", "ultimo_puntaje_animo",
                "cuidador_principal") == [
        ("Tomas Abril", 86, 3, "Hugo Prieto"), ("Olga Benito", 87, 2, "Bruno Leal"),
        ("Pilar Cano", 75, 1, "Hugo Prieto"), ("Rosa Egea", 80, None, None)]
    assert {r[0] for r in rows(views.pending_medication(t, AS_OF), "id_horario")} == {2}
    assert rows(views.sessions_today(t, AS_OF), "id_sesion", "hora") == [(3, "11:30 AM")]
    assert rows(views.staff_on_shift(t, AS_OF), "id_staff") == [(2,), (4,)]
    assert rows(views.rfid_today(t, AS_OF), "id_acceso") == [(3,), (2,), (1,)]
    assert [r[0] for r in rows(views.recent_incidents(t, AS_OF), "severidad")] == [
        "Alta", "Alta", "Alta", "Media", "Baja"]
    assert rows(views.staff_location(t, AS_OF), "staff", "ala_detectada",
                "minutos_desde_deteccion") == [
        ("Bruno Leal", "Sur", 40.0), ("Hugo Prieto", "Sur", 60.0)]
    assert rows(views.gps_status(t, AS_OF), "residente", "dentro_limite", "minutos_desde_ping") == [
        ("Tomas Abril", False, 10.0), ("Rosa Egea", True, 20.0)]


def test_two_limits_and_missing_rows(spark, t):
    everywhere = t["limite_jardin"].withColumns({
        "id_limite": F.col("id_limite") + 1, "lat_min": F.lit(-90).cast("decimal(10,7)"),
        "lat_max": F.lit(90).cast("decimal(10,7)"), "lon_min": F.lit(-180).cast("decimal(10,7)"),
        "lon_max": F.lit(180).cast("decimal(10,7)")})
    twice = {**t, "limite_jardin": everywhere.unionByName(t["limite_jardin"])}
    assert rows(views.gps_status(twice, AS_OF), "dentro_limite") == [(False,), (True,)]
    none = {**t, "limite_jardin": t["limite_jardin"].where("FALSE")}
    assert views.gps_status(none, AS_OF).count() == 0
    unseen = {**t, "deteccion_beacon": t["deteccion_beacon"].where("id_staff <> 4")}
    located = {r.id_staff: r.ala_detectada for r in views.staff_location(unseen, AS_OF).collect()}
    assert located[4] is None and len(located) == 2
    silent = {**t, "gps_ping": t["gps_ping"].where("FALSE")}
    assert views.gps_status(silent, AS_OF).count() == 0


def test_reports(t):
    assert rows(reports.unauthorised_accesses(t, AS_OF), "id_acceso") == []
    moved = {**t, "turno": t["turno"].withColumn("id_ala", F.lit(2).cast("bigint"))}
    assert rows(reports.unauthorised_accesses(moved, AS_OF), "id_acceso") == [(1,)]
    weekly = reports.weekly_summary(t, "2026-03-16")
    assert rows(weekly, "cuidador", "residentes_atendidos", "total_checkins",
                "puntaje_animo_promedio", "meds_administrados", "incidentes_reportados",
                "dosis_perdidas") == [
        ("Hugo Prieto", 3, 2, 2.0, 1, 3, 1), ("Bruno Leal", 1, 3, 3.67, 2, 1, 0)]
    assert rows(reports.weekly_summary(t, "2026-03-16", id_staff=2), "id_staff") == [(2,)]
    day = lambda n: dt.date(2026, 3, n)
    assert rows(reports.global_mood(t, AS_OF, 30)) == [
        (day(18), 4.0, 1), (day(19), 5.0, 1), (day(20), 3.0, 1), (day(21), 1.5, 2)]
    assert rows(reports.resident_mood(t, AS_OF, 30, id_residente=3)) == [
        (3, day(18), 4.0, 1), (3, day(21), 1.0, 1)]
    assert rows(reports.incidents_by_severity(t, AS_OF, 30)) == [
        ("Agitacion", "Alta", 1), ("Agitacion", "Media", 1), ("Caida", "Baja", 1),
        ("Deambulacion", "Alta", 2)]
    assert rows(reports.incident_matrix(t, AS_OF, 30)) == [
        ("Agitacion", 1, 1, 0), ("Caida", 0, 0, 1), ("Deambulacion", 2, 0, 0)]
    assert rows(reports.therapy_attendance(t, AS_OF, 30), "terapeuta", "total_programadas",
                "realizadas", "no_realizadas", "porcentaje") == [
        ("Irene Pardo", 3, 2, 1, 66)]
    assert rows(reports.sensor_summary(t, AS_OF, 30)) == [
        ("Beacon", 4), ("GPS", 4), ("NFC", 1), ("RFID", 4)]
    load = {r.profesional.split()[0]: (r.sesiones, r.checkins, r.incidentes)
            for r in reports.operational_load(t, AS_OF, 30).collect()}
    assert load == {"Bruno": (0, 3, 1), "Irene": (3, 0, 1), "Hugo": (0, 2, 3), "Sofia": (0, 0, 0)}
    assert rows(reports.admin_dashboard(t, AS_OF)) == [(4, 4, 3, 1)]
    therapists = {r[0]: r[1:] for r in rows(reports.therapist_dashboard(t, AS_OF))}
    assert therapists[1] == (2, 5, 3.0) and therapists[3] == (0, 5, None)
    today = {r[0]: r[1:] for r in rows(reports.caregiver_dashboard(t, AS_OF))}
    assert (today[1], today[2], today[4]) == ((0, 1), (1, 1), (1, 2))


def test_reader_without_wing_is_reported(t):
    loose = {**t, "lector_rfid": t["lector_rfid"].withColumn(
        "id_ala", F.when(F.col("id_lector") != 3, F.col("id_ala")))}
    assert {r[0] for r in rows(reports.unauthorised_accesses(loose, AS_OF), "id_acceso")} == {3}


def test_lists(t):
    assert rows(lists.caregiver_latest_mood(t, 2, at_most=2), "residente", "puntaje") == [
        ("Olga Benito", 2)]
    given = {r.id_log: (r.confirmado_por, r.metodo, r.dosis)
             for r in lists.medication_given_today(t, AS_OF).collect()}
    assert given == {3: ("Bruno Leal", "Manual", "5ml"), 1: ("Hugo Prieto", "NFC", "250mg")}
    detail = lists.resident_detail(t, AS_OF, 1).first()
    assert (detail.edad, detail.fecha_ingreso) == (87, "01 Feb 2025")
    roles = rows(lists.resident_assignments(t, 1), "staff_nombre", "tipo_rol", "es_principal")
    assert roles[0] == ("Bruno Leal", "Cuidador", True) and len(roles) == 3
    assert rows(lists.resident_sessions(t, 1), "id_sesion", "sala") == [
        (2, "Gabinete"), (1, "Gabinete")]
    assert rows(lists.resident_checkins(t, 1, k=1), "id_checkin") == [(2,)]
    assert len(rows(lists.resident_recent_incidents(t, 3))) == 2
    assert rows(lists.audit_log(t, 2), "id_registro", "fecha_hora") == [
        (1, "21 Mar 2026 03:00 PM"), (4, "20 Mar 2026 06:00 PM")]
    assert rows(lists.therapist_sessions_today(t, AS_OF, 1), "id_sesion") == [(3,)]
    assert {r.id_residente: r.total_sesiones for r in lists.therapist_residents(
        t, AS_OF, 1).collect()} == {1: 2, 3: 1}
    assert rows(lists.therapist_sessions(t, 1), "id_sesion") == [(3,), (2,), (1,)]
    assert rows(lists.pair_sessions(t, 1, 1), "id_sesion") == [(2,), (1,)]
    assert [r.apellidos for r in lists.residents_for_session(t, 1).collect()] == ["Benito", "Cano"]
    assert lists.resident_incidents(t, 3).count() == 2 and lists.all_incidents(t).count() == 6
    assert {r.id_residente for r in lists.caregiver_resident_ids(t, 4).collect()} == {1, 2, 3}
    assert {r.id_horario for r in lists.caregiver_pending_medication(t, AS_OF, 4).collect()} == {2}
    assert lists.caregiver_residents(t, AS_OF, 4).count() == 3
    assert lists.caregiver_resident_names(t, 2).count() == 1
    assert rows(lists.nfc_tags(t), "codigo_tag", "medicamento") == [("TAG-S1", "Calcio"), ("TAG-S3", None)]
    assert rows(lists.nfc_scans_today(t, AS_OF, 4), "hora", "residente") == [("07:40 AM", "Pilar Cano")]


def test_dimensions(t):
    assert [r.id_staff for r in dims.caregivers(t).collect()] == [2, 4]
    assert [r.id_staff for r in dims.staff_with_role(t).collect()] == [3, 1, 5, 2, 4]
    assert dims.roles(t).count() == 3 and dims.active_staff(t).count() == 4
    assert rows(dims.readers(t), "ala", "sala")[2] == ("Sur", "Gabinete")
    assert [r.nombre for r in dims.rooms(t).collect()] == ["Gabinete", "Salon", "Taller"]
    assert dims.garden_limit(t).count() == 1


def test_the_facility_breaks_no_rule(t):
    assert checks.table_report(t, AS_OF).collect() == []


def test_broken_rules_are_found(spark, t):
    bad = spark.createDataFrame(
        [(9, 1, 99, NOW, 7, None), (9, None, 4, NOW, 3, "x")],
        CARE["checkin_estado_animo"].replace(" NOT NULL", ""))
    found = {(r.regla, r.filas) for r in checks.table_report(
        {"checkin_estado_animo": bad, "residente": t["residente"], "staff": t["staff"]},
        AS_OF).where("tabla = 'checkin_estado_animo'").collect()}
    assert found == {("puntaje_rango", 1), ("id_residente_requerido", 1),
                     ("id_checkin_unico", 2), ("id_cuidador_referencia", 1)}
    young = t["residente"].withColumn("fecha_nacimiento", F.lit(TODAY))
    assert checks.row_violations(young, "id_residente", checks.row_rules(
        "residente", AS_OF)).count() == 5
