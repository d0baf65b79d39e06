"""Views, reports, lists, dimensions, alerts and checks over the derived care
tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.clinic_checks import mean, micros
from checks.star import CARE, EVENTS_NOW, WEEK, care, with_tables
from vigilia.functions import values as v
from vigilia.operators import checks as rules
from vigilia.operators.ranking import counts_by, head_and_rest
from vigilia.plans import alerts, dims, lists, reports, views
from vigilia.sources import CARE as SCHEMAS, load_tables, write_table
from vigilia.sources.work import new_folder

NOW = f"TIMESTAMP '{EVENTS_NOW}'"
TODAY = f"DATE '{EVENTS_NOW[:10]}'"


def _of(names: str, body: str, recursive: bool = False) -> str:
    return with_tables(CARE, names, body, recursive)


def _who(alias: str, name: str) -> str:
    return f"{alias}.nombre || ' ' || {alias}.apellidos AS {name}"


def _today(ts: str) -> str:
    return f"CAST({ts} AS DATE) = {TODAY}"


def _last_days(ts: str, days: int) -> str:
    return f"{ts} >= {NOW} - INTERVAL '{days}' DAY"


def _week(ts: str) -> str:
    return f"date_diff('day', DATE '{WEEK}', CAST({ts} AS DATE)) BETWEEN 0 AND 6"


# --- registered queries ----------------------------------------------------


def _text_search(s, d):
    incidents = lists.all_incidents(care(s, d), ordered=False)
    shown = ["residente", "reportado_por", "tipo", "severidad", "fecha"]
    return incidents.where(v.contains_text("r7 CUSTOMER", shown)
                           & v.tagged("severidad", "Alta")).select("id_incidente", *shown)


def _bands(s, d):
    t = care(s, d)
    attendance = reports.therapy_attendance(t, EVENTS_NOW, ordered=False)
    mood = views.latest_mood(t).groupBy(
        v.mood_label(F.col("puntaje")).alias("grupo"), v.mood_band(F.col("puntaje")).alias("banda")
    ).agg(F.count(F.lit(1)).alias("total"))
    mobility = t["residente"].groupBy(
        F.col("nivel_movilidad").alias("grupo"),
        v.mobility_band(F.col("nivel_movilidad")).alias("banda")).agg(
        F.count(F.lit(1)).alias("total"))
    severity = t["reporte_incidente"].groupBy(
        F.col("severidad").alias("grupo"), v.severity_band(F.col("severidad")).alias("banda")).agg(
        F.count(F.lit(1)).alias("total"))
    adherence = attendance.groupBy(
        F.lit("adherencia").alias("grupo"), v.adherence_band(F.col("porcentaje")).alias("banda")
    ).agg(F.count(F.lit(1)).alias("total"))
    return mood.unionByName(mobility).unionByName(severity).unionByName(adherence)


def _severity_counts(s, d):
    """The counters above the incident list; a label nobody uses counts 0."""
    return counts_by(lists.all_incidents(care(s, d), ordered=False), "severidad",
                     ["Alta", "Media", "Baja", "Ninguna"])


def _round_trip(s, d):
    """A table written by day and opened again with its declared schema."""
    name, folder = "checkin_estado_animo", new_folder(s, "tables")
    write_table(care(s, d)[name], f"{folder}/{name}", name)
    return load_tables(s, folder, SCHEMAS, [name])[name]


def _by_day(report, names: str):
    """``report`` on tables written to the shared folder, events by day, and read back."""
    def query(s, d):
        t, folder = care(s, d), new_folder(s, "tables")
        for name in names.split():
            write_table(t[name], f"{folder}/{name}", name)
        return report(load_tables(s, folder, SCHEMAS, names.split()))
    return query


BY_DAY = {
    "sessions_today": (lambda t: views.sessions_today(t, EVENTS_NOW), "sesion_terapia residente staff sala"),
    "rfid_today": (lambda t: views.rfid_today(t, EVENTS_NOW), "acceso_rfid staff lector_rfid ala"),
    "daily_evolution": (lambda t: reports.global_mood(t, EVENTS_NOW, 30), "checkin_estado_animo"),
    "feed_counts": (lambda t: reports.sensor_summary(t, EVENTS_NOW, 10),
                    "gps_ping nfc_evento acceso_rfid deteccion_beacon"),
}

RULES_DAY = "2021-06-30"
ALL_TABLES = " ".join(rules.UNIQUE)


def _row_rules(s, d):
    t, out = care(s, d), None
    for name in rules.UNIQUE:
        key = rules.UNIQUE[name][0][0]
        part = rules.row_violations(t[name], key, rules.row_rules(name, RULES_DAY)).select(
            F.lit(name).alias("tabla"), F.col(key).alias("clave"), "regla")
        out = part if out is None else out.unionByName(part)
    return out


def _duplicates(s, d):
    t, out = care(s, d), None
    for name, columns in ((n, c) for n, sets in rules.UNIQUE.items() for c in sets):
        part = rules.duplicate_keys(t[name], columns).select(
            F.lit(name).alias("tabla"), F.lit("_".join(columns)).alias("columnas"),
            F.col(columns[0]).cast("string").alias("valor"), "filas")
        out = part if out is None else out.unionByName(part)
    return out


def _orphans(s, d):
    t, out = care(s, d), None
    for table, column, parent, key in _references():
        part = rules.orphan_keys(t[table], column, t[parent], key).withColumns(
            {"tabla": F.lit(table), "columna": F.lit(column)})
        out = part if out is None else out.unionByName(part)
    return out


def _references():
    return [(table, column, parent, key) for table, links in rules.REFERENCES.items()
            for column, (parent, key) in links.items()]


def _rule_report(s, d):
    t = care(s, d)
    return rules.table_report({n: t[n] for n in rules.UNIQUE}, RULES_DAY)


def _row_rule_sql():
    """(table, rule, condition that a row breaks it on)."""
    for table in rules.UNIQUE:
        for rule, text in rules.ROW_RULES.get(table, {}).items():
            ok = text.replace("add_months({today}, -720)", f"DATE '{RULES_DAY}' - INTERVAL 720 MONTH")
            yield table, rule, f"NOT ({ok})"
        for c in rules.REQUIRED[table].split():
            yield table, f"{c}_requerido", f"{c} IS NULL"
        for c, longest in rules.LENGTHS.get(table, {}).items():
            yield table, f"{c}_largo", f"length({c}) > {longest}"


QUERIES = {
    # Views
    "geofence_status": lambda s, d: views.gps_status(care(s, d), EVENTS_NOW),
    "entity_overview": lambda s, d: views.residents_summary(care(s, d), EVENTS_NOW),
    "pending_today": lambda s, d: views.pending_medication(care(s, d), EVENTS_NOW),
    "sessions_today": lambda s, d: views.sessions_today(care(s, d), EVENTS_NOW),
    "staff_on_shift": lambda s, d: views.staff_on_shift(care(s, d), EVENTS_NOW),
    "rfid_today": lambda s, d: views.rfid_today(care(s, d), EVENTS_NOW),
    "recent_ranked": lambda s, d: views.recent_incidents(care(s, d), EVENTS_NOW),
    "staff_location": lambda s, d: views.staff_location(care(s, d), EVENTS_NOW),
    # Reports
    "residents_outdoors": lambda s, d: reports.residents_outdoors(care(s, d), EVENTS_NOW),
    "access_log": lambda s, d: reports.access_log(care(s, d), "2024-01-28"),
    "unauthorised_access": lambda s, d: reports.unauthorised_accesses(care(s, d), "2024-01-28"),
    "staff_last_seen": lambda s, d: reports.staff_last_seen(care(s, d), EVENTS_NOW),
    "weekly_summary": lambda s, d: reports.weekly_summary(care(s, d), WEEK),
    "resident_evolution": lambda s, d: reports.resident_mood(care(s, d), EVENTS_NOW, 30),
    "daily_evolution": lambda s, d: reports.global_mood(care(s, d), EVENTS_NOW, 30),
    "incident_severity": lambda s, d: reports.incidents_by_severity(care(s, d), EVENTS_NOW, 20),
    "severity_pivot": lambda s, d: reports.incident_matrix(care(s, d), EVENTS_NOW, 20),
    "attendance": lambda s, d: reports.therapy_attendance(care(s, d), EVENTS_NOW, 30),
    "feed_counts": lambda s, d: reports.sensor_summary(care(s, d), EVENTS_NOW, 10),
    "load": lambda s, d: reports.operational_load(care(s, d), EVENTS_NOW, 14),
    "dashboard": lambda s, d: reports.admin_dashboard(care(s, d), EVENTS_NOW),
    "therapist_dashboard": lambda s, d: reports.therapist_dashboard(care(s, d), EVENTS_NOW),
    "caregiver_dashboard": lambda s, d: reports.caregiver_dashboard(care(s, d), EVENTS_NOW),
    # Lists
    "resident_detail": lambda s, d: lists.resident_detail(care(s, d), EVENTS_NOW),
    "resident_assignments": lambda s, d: lists.resident_assignments(care(s, d)),
    "top_k_history": lambda s, d: lists.resident_sessions(care(s, d)),
    "checkin_history": lambda s, d: lists.resident_checkins(care(s, d)),
    "incident_history": lambda s, d: lists.resident_recent_incidents(care(s, d)),
    "audit_log": lambda s, d: lists.audit_log(care(s, d)),
    "therapist_today": lambda s, d: lists.therapist_sessions_today(care(s, d), EVENTS_NOW),
    "therapist_residents": lambda s, d: lists.therapist_residents(care(s, d), EVENTS_NOW),
    "therapist_sessions": lambda s, d: lists.therapist_sessions(care(s, d), ordered=False),
    "pair_sessions": lambda s, d: lists.pair_sessions(care(s, d), ordered=False),
    "residents_for_session": lambda s, d: lists.residents_for_session(care(s, d)),
    "resident_incidents": lambda s, d: lists.resident_incidents(care(s, d), ordered=False),
    "all_incidents": lambda s, d: lists.all_incidents(care(s, d), ordered=False),
    "caregiver_resident_ids": lambda s, d: lists.caregiver_resident_ids(care(s, d)),
    "caregiver_pending": lambda s, d: lists.caregiver_pending_medication(care(s, d), EVENTS_NOW),
    "latest_low": lambda s, d: lists.caregiver_latest_mood(care(s, d), at_most=2),
    "caregiver_residents": lambda s, d: lists.caregiver_residents(care(s, d), EVENTS_NOW),
    "caregiver_resident_names": lambda s, d: lists.caregiver_resident_names(care(s, d)),
    "medication_given": lambda s, d: lists.medication_given_today(care(s, d), EVENTS_NOW),
    "nfc_tags": lambda s, d: lists.nfc_tags(care(s, d)),
    "nfc_scans_today": lambda s, d: lists.nfc_scans_today(care(s, d), EVENTS_NOW),
    # Dimensions
    "dim_caregivers": lambda s, d: dims.caregivers(care(s, d)),
    "dim_staff": lambda s, d: dims.staff_with_role(care(s, d)),
    "dim_roles": lambda s, d: dims.roles(care(s, d)),
    "dim_readers": lambda s, d: dims.readers(care(s, d)),
    "dim_active_staff": lambda s, d: dims.active_staff(care(s, d)),
    "dim_rooms": lambda s, d: dims.rooms(care(s, d)),
    "dim_garden_limit": lambda s, d: dims.garden_limit(care(s, d)),
    # Alerts
    "low_mood_incidents": lambda s, d: alerts.low_mood_incidents(
        care(s, d)["checkin_estado_animo"]),
    "geofence_alerts": lambda s, d: alerts.geofence_incidents(care(s, d)["gps_ping"], care(s, d)),
    "restricted_audit": lambda s, d: alerts.restricted_access_audit(
        care(s, d)["acceso_rfid"], care(s, d)),
    # Result transforms and checks
    "text_search": _text_search,
    "bands": _bands,
    "severity_counts": _severity_counts,
    "pending_head": lambda s, d: head_and_rest(
        views.pending_medication(care(s, d), EVENTS_NOW, ordered=False),
        [F.asc("hora_programada"), F.asc("id_horario")]),
    "constraint_violations": _row_rules,
    "orphans": _orphans,
    "duplicates": _duplicates,
    "rule_report": _rule_report,
    "resident_by_id": lambda s, d: lists.resident_detail(care(s, d), EVENTS_NOW, 7),
    "sessions_by_week": lambda s, d: reports.sessions_by_week(care(s, d)),
    "table_round_trip": _round_trip,
} | {f"{name}_by_day": _by_day(*what) for name, what in BY_DAY.items()}

# --- SQL -------------------------------------------------------------------

MOOD = (", mood AS (SELECT * FROM checkin_estado_animo QUALIFY ROW_NUMBER() OVER "
        "(PARTITION BY id_residente ORDER BY fecha_registro DESC, id_checkin DESC) = 1)")
CARER = (", carer AS (SELECT id_residente, s.nombre || ' ' || s.apellidos AS name "
         "FROM asignacion a LEFT JOIN staff s USING (id_staff) WHERE a.es_principal "
         "AND a.tipo_rol = 'Cuidador' AND a.fecha_fin IS NULL)")
SUMMARY = MOOD + CARER + f"""
, summary AS (
SELECT r.id_residente, {_who('r', 'residente')}, r.habitacion, r.diagnostico_principal,
       r.nivel_movilidad,
       CAST(EXTRACT(YEAR FROM age({TODAY}, r.fecha_nacimiento)) AS INTEGER) AS edad,
       carer.name AS cuidador_principal, mood.puntaje AS ultimo_puntaje_animo,
       strftime(mood.fecha_registro, '%d %b %I:%M %p') AS fecha_ultimo_checkin, r.fecha_ingreso
FROM residente r LEFT JOIN carer USING (id_residente) LEFT JOIN mood USING (id_residente)
WHERE r.activo)"""
SUMMARY_TABLES = "residente asignacion staff checkin_estado_animo"
PENDING = CARER + f"""
, pending AS (
SELECT h.id_horario, r.id_residente, {_who('r', 'residente')}, r.habitacion,
       m.nombre AS medicamento, h.dosis, h.hora_programada, carer.name AS cuidador_asignado
FROM horario_medicamento h JOIN residente r USING (id_residente)
JOIN medicamento m USING (id_medicamento) LEFT JOIN carer ON carer.id_residente = r.id_residente
WHERE h.activo AND r.activo AND h.id_horario NOT IN
      (SELECT id_horario FROM log_medicamento WHERE {_today('fecha_administracion')}))"""
PENDING_TABLES = "residente asignacion staff horario_medicamento medicamento log_medicamento"
PING = (", ping AS (SELECT * FROM gps_ping QUALIFY ROW_NUMBER() OVER (PARTITION BY id_residente "
        "ORDER BY registrado_en DESC, id_ping DESC) = 1)")
STATUS = _of("residente gps_ping limite_jardin", PING + f"""
SELECT r.id_residente, {_who('r', 'residente')}, r.habitacion, g.latitud, g.longitud,
       g.registrado_en,
       g.latitud >= b.lat_min AND g.latitud <= b.lat_max AND g.longitud >= b.lon_min
           AND g.longitud <= b.lon_max AS dentro_limite,
       {micros('g.registrado_en', NOW)} / 60000000.0 AS minutos_desde_ping
FROM residente r JOIN ping g USING (id_residente) CROSS JOIN (SELECT * FROM limite_jardin ORDER BY id_limite LIMIT 1) b WHERE r.activo""")
ACCESS = """
SELECT a.id_acceso, {who}, s.especialidad, l.ubicacion, w.nombre AS ala{more},
       strftime(a.accedido_en, '%I:%M %p') AS hora
FROM acceso_rfid a JOIN staff s USING (id_staff) JOIN lector_rfid l USING (id_lector)
LEFT JOIN ala w ON w.id_ala = l.id_ala WHERE {condition}"""
ACCESS_TABLES = "acceso_rfid staff lector_rfid ala"
FLAGS = ", l.es_restringido, a.acceso_concedido"
LOCATION = """
, seen AS (SELECT x.id_staff, x.detectado_en, b.id_ala
           FROM deteccion_beacon x JOIN beacon b USING (id_beacon)
           QUALIFY ROW_NUMBER() OVER (PARTITION BY x.id_staff
                                      ORDER BY x.detectado_en DESC, x.id_deteccion DESC) = 1)
SELECT s.id_staff, {who}, s.especialidad, r.nombre_rol AS rol, w.nombre AS ala_detectada,
       {time}, {minutes} / 60000000.0 AS minutos_desde_deteccion
FROM turno t JOIN staff s USING (id_staff) JOIN rol r USING (id_rol)
LEFT JOIN seen ON seen.id_staff = s.id_staff LEFT JOIN ala w ON w.id_ala = seen.id_ala
WHERE s.activo AND t.fecha = {today}"""
LOCATION_TABLES = "turno staff rol ala beacon deteccion_beacon"


def _location(time: str) -> str:
    return _of(LOCATION_TABLES, LOCATION.format(
        who=_who("s", "staff"), time=time, minutes=micros("seen.detectado_en", NOW), today=TODAY))


def _history(table: str, join: str, columns: str, ts: str, key: str, k: int, tables: str) -> str:
    return _of(tables, f"""
SELECT {columns} FROM {table} x {join}
QUALIFY ROW_NUMBER() OVER (PARTITION BY x.id_residente ORDER BY x.{ts} DESC, x.{key} DESC) <= {k}""")


def _incidents(fecha: str, extra: str = "", join: str = "", tables: str = "") -> str:
    return _of(f"reporte_incidente staff {tables}", f"""
SELECT x.id_incidente, x.id_residente, x.id_staff, strftime(x.fecha, '{fecha}') AS fecha, x.tipo,
       x.descripcion, x.severidad, {_who('s', 'reportado_por')}{extra}
FROM reporte_incidente x JOIN staff s USING (id_staff) {join}""")


MINE = """, mine AS (SELECT a.id_staff, a.id_residente FROM asignacion a
           WHERE a.fecha_fin IS NULL {role})"""
CARE_ROLE = "AND a.tipo_rol = 'Cuidador'"


def _assigned(role: str, columns: str) -> str:
    return _of("asignacion residente", MINE.format(role=role) + f"""
SELECT mine.id_staff, r.id_residente{columns} FROM mine JOIN residente r USING (id_residente)
WHERE r.activo""")


def _load(table: str, key: str, ts: str) -> str:
    return f"(SELECT COUNT(*) FROM {table} x WHERE x.{key} = s.id_staff AND {_last_days('x.' + ts, 14)})"


ORACLES = {
    "geofence_status": STATUS,
    "residents_outdoors": STATUS,
    "entity_overview": _of(SUMMARY_TABLES, SUMMARY + " SELECT * FROM summary"),
    "pending_today": _of(PENDING_TABLES, PENDING + " SELECT * FROM pending"),
    "sessions_today": _of("sesion_terapia residente staff sala", f"""
SELECT x.id_sesion, {_who('r', 'residente')}, r.habitacion, {_who('s', 'terapeuta')},
       o.nombre AS sala, x.tipo_sesion, x.duracion_min,
       strftime(x.fecha_sesion, '%I:%M %p') AS hora, x.asistio
FROM sesion_terapia x JOIN residente r USING (id_residente)
JOIN staff s ON s.id_staff = x.id_terapeuta JOIN sala o USING (id_sala)
WHERE {_today('x.fecha_sesion')}"""),
    "staff_on_shift": _of("turno staff ala rol", f"""
SELECT s.id_staff, {_who('s', 'staff')}, s.especialidad, r.nombre_rol AS rol, w.nombre AS ala,
       t.hora_inicio, t.hora_fin
FROM turno t JOIN staff s USING (id_staff) JOIN ala w USING (id_ala) JOIN rol r USING (id_rol)
WHERE s.activo AND t.fecha = {TODAY}"""),
    "rfid_today": _of(ACCESS_TABLES, ACCESS.format(
        who=_who("s", "staff"), more=FLAGS, condition=_today("a.accedido_en"))),
    "access_log": _of(ACCESS_TABLES, ACCESS.format(
        who=_who("s", "staff"), more=FLAGS,
        condition="CAST(a.accedido_en AS DATE) = DATE '2024-01-28'")),
    "unauthorised_access": _of(ACCESS_TABLES + " turno", ACCESS.format(
        who=_who("s", "staff"), more="",
        condition="CAST(a.accedido_en AS DATE) = DATE '2024-01-28' AND l.es_restringido "
                  "AND a.acceso_concedido AND (l.id_ala IS NULL OR (a.id_staff, l.id_ala) NOT IN "
                  "(SELECT (id_staff, id_ala) FROM turno WHERE fecha = DATE '2024-01-28'))")),
    "recent_ranked": _of("reporte_incidente residente staff", f"""
SELECT x.id_incidente, {_who('r', 'residente')}, r.habitacion, {_who('s', 'reportado_por')},
       x.tipo, x.severidad, x.descripcion, strftime(x.fecha, '%d %b %I:%M %p') AS fecha
FROM reporte_incidente x JOIN residente r USING (id_residente) JOIN staff s USING (id_staff)
WHERE {_last_days('x.fecha', 7)}"""),
    "staff_location": _location("strftime(seen.detectado_en, '%I:%M %p') AS ultima_deteccion"),
    "staff_last_seen": _location("seen.detectado_en"),
    "weekly_summary": _of("staff rol asignacion checkin_estado_animo log_medicamento "
                          "reporte_incidente horario_medicamento", f"""
, given AS (SELECT * FROM log_medicamento WHERE {_week('fecha_administracion')})
SELECT s.id_staff, {_who('s', 'cuidador')}, DATE '{WEEK}' AS semana_inicio,
       DATE '{WEEK}' + 6 AS semana_fin,
       (SELECT COUNT(DISTINCT id_residente) FROM asignacion a WHERE a.id_staff = s.id_staff
        AND a.tipo_rol = 'Cuidador' AND COALESCE(a.fecha_fin >= DATE '{WEEK}', TRUE))
           AS residentes_atendidos,
       (SELECT COUNT(*) FROM checkin_estado_animo c WHERE c.id_cuidador = s.id_staff
        AND {_week('c.fecha_registro')}) AS total_checkins,
       (SELECT {mean('c.puntaje', 2)} FROM checkin_estado_animo c
        WHERE c.id_cuidador = s.id_staff AND {_week('c.fecha_registro')})
           AS puntaje_animo_promedio,
       (SELECT COUNT(*) FROM given g WHERE g.id_cuidador = s.id_staff) AS meds_administrados,
       (SELECT COUNT(*) FROM reporte_incidente i WHERE i.id_staff = s.id_staff
        AND {_week('i.fecha')}) AS incidentes_reportados,
       (SELECT COUNT(*) FROM asignacion a JOIN horario_medicamento h USING (id_residente)
        WHERE a.id_staff = s.id_staff AND a.tipo_rol = 'Cuidador' AND h.activo
        AND h.id_horario NOT IN (SELECT id_horario FROM given)) AS dosis_perdidas
FROM staff s JOIN rol r USING (id_rol) WHERE s.activo AND r.nivel_acceso = 3"""),
    "resident_evolution": _of("checkin_estado_animo", f"""
SELECT id_residente, CAST(fecha_registro AS DATE) AS fecha, {mean('puntaje', 2)} AS puntaje_promedio,
       COUNT(*) AS num_registros
FROM checkin_estado_animo WHERE {_last_days('fecha_registro', 30)} GROUP BY ALL"""),
    "daily_evolution": _of("checkin_estado_animo", f"""
SELECT CAST(fecha_registro AS DATE) AS fecha, {mean('puntaje', 2)} AS puntaje_promedio,
       COUNT(*) AS num_registros
FROM checkin_estado_animo WHERE {_last_days('fecha_registro', 30)} GROUP BY ALL"""),
    "incident_severity": _of("reporte_incidente", f"""
SELECT tipo, severidad, COUNT(*) AS total FROM reporte_incidente
WHERE {_last_days('fecha', 20)} GROUP BY ALL"""),
    "severity_pivot": _of("reporte_incidente", f"""
SELECT tipo, COUNT(*) FILTER (severidad = 'Alta') AS Alta,
       COUNT(*) FILTER (severidad = 'Media') AS Media, COUNT(*) FILTER (severidad = 'Baja') AS Baja
FROM reporte_incidente WHERE {_last_days('fecha', 20)} GROUP BY tipo"""),
    "attendance": _of("staff rol sesion_terapia", f"""
, x AS (SELECT s.id_staff, {_who('s', 'terapeuta')}, COUNT(y.id_sesion) AS p,
               COUNT(*) FILTER (y.asistio) AS a, COUNT(*) FILTER (NOT y.asistio) AS m
        FROM staff s JOIN rol r USING (id_rol) LEFT JOIN sesion_terapia y
          ON y.id_terapeuta = s.id_staff AND {_last_days('y.fecha_sesion', 30)}
        WHERE s.activo AND r.nivel_acceso = 2 GROUP BY ALL)
SELECT id_staff, terapeuta, p AS total_programadas, a AS realizadas, m AS no_realizadas,
       CASE WHEN p = 0 THEN 0 ELSE CAST(TRUNC(CAST(a AS DOUBLE) / p * 100) AS BIGINT) END
           AS porcentaje FROM x"""),
    "feed_counts": _of("gps_ping nfc_evento acceso_rfid deteccion_beacon", " UNION ALL ".join(
        f"SELECT '{label}' AS tipo_evento, COUNT(*) AS total FROM {table} WHERE {_last_days(ts, 10)}"
        for label, (table, ts) in reports.FEEDS.items())),
    "load": _of("staff rol sesion_terapia checkin_estado_animo reporte_incidente", f"""
, x AS (SELECT s.id_staff, {_who('s', 'profesional')}, r.nombre_rol AS rol,
       {_load('sesion_terapia', 'id_terapeuta', 'fecha_sesion')} AS sesiones,
       {_load('checkin_estado_animo', 'id_cuidador', 'fecha_registro')} AS checkins,
       {_load('reporte_incidente', 'id_staff', 'fecha')} AS incidentes
FROM staff s JOIN rol r USING (id_rol) WHERE s.activo)
SELECT *, sesiones + checkins + incidentes AS total FROM x"""),
    "dashboard": _of(PENDING_TABLES + " reporte_incidente", PENDING + f"""
SELECT (SELECT COUNT(*) FROM residente WHERE activo) AS total_residentes,
       (SELECT COUNT(*) FROM staff WHERE activo) AS total_staff,
       (SELECT COUNT(*) FROM reporte_incidente WHERE severidad = 'Alta'
        AND {_last_days('fecha', 7)}) AS incidentes_alta,
       (SELECT COUNT(*) FROM pending) AS meds_pendientes"""),
    "therapist_dashboard": _of("staff asignacion residente reporte_incidente checkin_estado_animo",
                               MINE.format(role="") + f"""
SELECT s.id_staff,
       (SELECT COUNT(DISTINCT r.id_residente) FROM mine JOIN residente r USING (id_residente)
        WHERE mine.id_staff = s.id_staff AND r.activo) AS total_residentes,
       (SELECT COUNT(*) FROM reporte_incidente WHERE {_last_days('fecha', 7)})
           AS incidentes_activos,
       (SELECT {mean('c.puntaje', 1)} FROM mine JOIN checkin_estado_animo c USING (id_residente)
        WHERE mine.id_staff = s.id_staff AND {_last_days('c.fecha_registro', 7)})
           AS animo_promedio
FROM staff s"""),
    "caregiver_dashboard": _of("staff checkin_estado_animo reporte_incidente", f"""
SELECT s.id_staff,
       (SELECT COUNT(*) FROM checkin_estado_animo c WHERE c.id_cuidador = s.id_staff
        AND {_today('c.fecha_registro')}) AS checkins_hoy,
       (SELECT COUNT(*) FROM reporte_incidente i WHERE i.id_staff = s.id_staff
        AND {_today('i.fecha')}) AS incidentes_hoy
FROM staff s"""),
    "resident_detail": _of("residente", f"""
SELECT * REPLACE (strftime(fecha_ingreso, '%d %b %Y') AS fecha_ingreso),
       CAST(EXTRACT(YEAR FROM age({TODAY}, fecha_nacimiento)) AS INTEGER) AS edad
FROM residente"""),
    "resident_assignments": _of("asignacion staff rol", f"""
SELECT a.* REPLACE (r.nombre_rol AS tipo_rol), {_who('s', 'staff_nombre')}
FROM asignacion a JOIN staff s USING (id_staff) JOIN rol r USING (id_rol)
WHERE a.fecha_fin IS NULL"""),
    "top_k_history": _history(
        "sesion_terapia", "JOIN staff s ON s.id_staff = x.id_terapeuta JOIN sala o USING (id_sala)",
        f"x.*, {_who('s', 'terapeuta')}, o.nombre AS sala", "fecha_sesion", "id_sesion", 10,
        "sesion_terapia staff sala"),
    "checkin_history": _history(
        "checkin_estado_animo", "JOIN staff s ON s.id_staff = x.id_cuidador",
        f"x.*, {_who('s', 'cuidador')}", "fecha_registro", "id_checkin", 10,
        "checkin_estado_animo staff"),
    "incident_history": _history(
        "reporte_incidente", "JOIN staff s ON s.id_staff = x.id_staff",
        f"x.* REPLACE (strftime(x.fecha, '%d %b %Y %I:%M %p') AS fecha), {_who('s', 'reportado_por')}",
        "fecha", "id_incidente", 5, "reporte_incidente staff"),
    "audit_log": _of("log_auditoria usuario_sistema staff", f"""
SELECT l.*, u.username, {_who('s', 'usuario_nombre')},
       strftime(l.timestamp_operacion, '%d %b %Y %I:%M %p') AS fecha_hora
FROM log_auditoria l JOIN usuario_sistema u USING (id_usuario) JOIN staff s USING (id_staff)
ORDER BY l.timestamp_operacion DESC, l.id_log DESC LIMIT 200"""),
    "therapist_today": _of("sesion_terapia residente sala", f"""
SELECT x.*, {_who('r', 'residente')}, o.nombre AS sala,
       strftime(x.fecha_sesion, '%I:%M %p') AS hora_inicio
FROM sesion_terapia x JOIN residente r USING (id_residente) JOIN sala o USING (id_sala)
WHERE {_today('x.fecha_sesion')}"""),
    "therapist_residents": _of(SUMMARY_TABLES + " sesion_terapia",
                               SUMMARY + MINE.format(role="") + """
SELECT y.*, mine.id_staff, (SELECT COUNT(*) FROM sesion_terapia x
    WHERE x.id_residente = y.id_residente AND x.id_terapeuta = mine.id_staff) AS total_sesiones
FROM summary y JOIN (SELECT DISTINCT * FROM mine) mine USING (id_residente)"""),
    "therapist_sessions": _of("sesion_terapia residente sala", f"""
SELECT x.*, {_who('r', 'residente')}, o.nombre AS sala,
       strftime(x.fecha_sesion, '%d %b %Y %I:%M %p') AS fecha_sesion_fmt
FROM sesion_terapia x JOIN residente r USING (id_residente) JOIN sala o USING (id_sala)"""),
    "pair_sessions": _of("sesion_terapia sala", """
SELECT x.*, o.nombre AS sala FROM sesion_terapia x JOIN sala o USING (id_sala)"""),
    "residents_for_session": _assigned("", ", r.nombre, r.apellidos, r.habitacion"),
    "resident_incidents": _incidents("%d %b %Y"),
    "all_incidents": _incidents("%d %b %Y %I:%M %p", ", " + _who("r", "residente"),
                                "JOIN residente r ON r.id_residente = x.id_residente", "residente"),
    "caregiver_resident_ids": _assigned(CARE_ROLE, ""),
    "caregiver_pending": _of(PENDING_TABLES, PENDING + MINE.format(role=CARE_ROLE) + """
SELECT pending.*, mine.id_staff FROM pending JOIN mine USING (id_residente)"""),
    "latest_low": _of("checkin_estado_animo asignacion residente",
                      MOOD + MINE.format(role=CARE_ROLE) + f"""
SELECT mine.id_staff, r.id_residente, {_who('r', 'residente')}, mood.puntaje
FROM (SELECT DISTINCT * FROM mine) mine JOIN mood USING (id_residente)
JOIN residente r USING (id_residente) WHERE mood.puntaje IN (1, 2)"""),
    "caregiver_residents": _of(SUMMARY_TABLES, SUMMARY + MINE.format(role=CARE_ROLE) + """
SELECT summary.*, mine.id_staff
FROM summary JOIN (SELECT DISTINCT * FROM mine) mine USING (id_residente)"""),
    "caregiver_resident_names": _assigned(CARE_ROLE, ", r.nombre, r.apellidos, r.habitacion"),
    "medication_given": _of("log_medicamento horario_medicamento medicamento residente staff "
                            "nfc_evento", f"""
SELECT x.*, m.nombre AS medicamento, h.dosis, {_who('r', 'residente')}, r.habitacion,
       {_who('s', 'confirmado_por')}, strftime(x.fecha_administracion, '%I:%M %p') AS hora_administrado,
       IF(n.id_evento IS NULL, 'Manual', 'NFC') AS metodo
FROM log_medicamento x JOIN horario_medicamento h USING (id_horario)
JOIN medicamento m USING (id_medicamento) JOIN residente r USING (id_residente)
JOIN staff s ON s.id_staff = x.id_cuidador LEFT JOIN nfc_evento n ON n.id_log_med = x.id_log
WHERE {_today('x.fecha_administracion')}"""),
    "nfc_tags": _of("nfc_tag residente horario_medicamento medicamento", f"""
SELECT t.id_tag, t.codigo_tag, t.descripcion, {_who('r', 'residente')}, r.habitacion,
       COALESCE(m.nombre, t.descripcion) AS medicamento
FROM nfc_tag t JOIN residente r USING (id_residente)
LEFT JOIN horario_medicamento h ON h.id_residente = t.id_residente
LEFT JOIN medicamento m USING (id_medicamento)
QUALIFY ROW_NUMBER() OVER (PARTITION BY t.id_tag ORDER BY h.id_horario) = 1"""),
    "nfc_scans_today": _of("nfc_evento nfc_tag residente", f"""
SELECT e.id_staff, e.id_evento, strftime(e.escaneado_en, '%I:%M %p') AS hora,
       t.descripcion AS medicamento, {_who('r', 'residente')}
FROM nfc_evento e JOIN nfc_tag t USING (id_tag) JOIN residente r USING (id_residente)
WHERE {_today('e.escaneado_en')}
QUALIFY ROW_NUMBER() OVER (PARTITION BY e.id_staff
                           ORDER BY e.escaneado_en DESC, e.id_evento DESC) <= 10"""),
    "dim_caregivers": _of("staff rol", f"""
SELECT s.id_staff, {_who('s', 'nombre')} FROM staff s JOIN rol r USING (id_rol)
WHERE s.activo AND r.nivel_acceso = 3"""),
    "dim_staff": _of("staff rol", """
SELECT s.*, r.nombre_rol, r.nivel_acceso, strftime(s.fecha_alta, '%d %b %Y') AS fecha_alta_fmt
FROM staff s JOIN rol r USING (id_rol)"""),
    "dim_roles": _of("rol", "SELECT * FROM rol"),
    "dim_readers": _of("lector_rfid ala sala", """
SELECT l.*, w.nombre AS ala, o.nombre AS sala FROM lector_rfid l
LEFT JOIN ala w ON w.id_ala = l.id_ala LEFT JOIN sala o ON o.id_sala = l.id_sala"""),
    "dim_active_staff": _of("staff rol", """
SELECT s.id_staff, s.nombre, s.apellidos, r.nombre_rol
FROM staff s JOIN rol r USING (id_rol) WHERE s.activo"""),
    "dim_rooms": _of("sala ala", """
SELECT o.*, w.nombre AS ala FROM sala o LEFT JOIN ala w ON w.id_ala = o.id_ala"""),
    "dim_garden_limit": _of("limite_jardin", "SELECT * FROM limite_jardin ORDER BY id_limite LIMIT 1"),
    "low_mood_incidents": _of("checkin_estado_animo", """
SELECT id_residente, id_cuidador AS id_staff, fecha_registro AS fecha, 'Agitacion' AS tipo,
       format('Alerta automática: puntaje de ánimo bajo ({}/5) registrado por cuidador.', puntaje)
           AS descripcion, IF(puntaje = 1, 'Alta', 'Media') AS severidad
FROM checkin_estado_animo WHERE puntaje IN (1, 2)"""),
    "geofence_alerts": _of("gps_ping limite_jardin asignacion", """
, carer AS (SELECT id_residente, arg_min(id_staff, id_asignacion) AS id_staff FROM asignacion
            WHERE fecha_fin IS NULL AND es_principal AND tipo_rol = 'Cuidador' GROUP BY 1)
SELECT g.id_residente, COALESCE(carer.id_staff, 1) AS id_staff, g.registrado_en AS fecha,
       'Deambulacion' AS tipo,
       'Alerta GPS: residente detectado fuera del perímetro del jardín. Coords: ('
           || g.latitud || ', ' || g.longitud || ').' AS descripcion, 'Alta' AS severidad
FROM gps_ping g CROSS JOIN (SELECT * FROM limite_jardin ORDER BY id_limite LIMIT 1) b LEFT JOIN carer USING (id_residente)
WHERE g.latitud < b.lat_min OR g.latitud > b.lat_max OR g.longitud < b.lon_min
   OR g.longitud > b.lon_max"""),
    "restricted_audit": _of("acceso_rfid lector_rfid usuario_sistema", """
, u AS (SELECT id_staff, MIN(id_usuario) AS id_usuario FROM usuario_sistema WHERE activo GROUP BY 1)
SELECT u.id_usuario, 'acceso_rfid' AS tabla_afectada, 'INSERT' AS operacion,
       a.id_acceso AS id_registro, CAST(NULL AS VARCHAR) AS ip_origen,
       a.accedido_en AS timestamp_operacion
FROM acceso_rfid a JOIN lector_rfid l USING (id_lector) JOIN u ON u.id_staff = a.id_staff
WHERE l.es_restringido"""),
    "text_search": _of("reporte_incidente staff residente", f"""
, x AS (SELECT i.id_incidente, {_who('r', 'residente')}, {_who('s', 'reportado_por')}, i.tipo,
               i.severidad, strftime(i.fecha, '%d %b %Y %I:%M %p') AS fecha
        FROM reporte_incidente i JOIN staff s USING (id_staff) JOIN residente r USING (id_residente))
SELECT * FROM x WHERE severidad = 'Alta' AND lower(residente || ' ' || reportado_por || ' '
       || tipo || ' ' || severidad || ' ' || fecha) LIKE '%r7 customer%'"""),
    "bands": _of("checkin_estado_animo residente reporte_incidente staff rol sesion_terapia",
                 MOOD + f"""
, b AS (
SELECT ['Muy bajo', 'Bajo', 'Regular', 'Bueno', 'Excelente'][puntaje] AS grupo,
       ['danger', 'danger', 'warning', 'success', 'success'][puntaje] AS banda FROM mood
UNION ALL SELECT nivel_movilidad, CASE nivel_movilidad WHEN 'Encamado' THEN 'danger'
       WHEN 'Asistido' THEN 'warning' ELSE 'success' END FROM residente
UNION ALL SELECT severidad, CASE severidad WHEN 'Baja' THEN 'success' WHEN 'Media' THEN 'warning'
       ELSE 'danger' END FROM reporte_incidente
UNION ALL SELECT 'adherencia', CASE WHEN p < 50 THEN 'danger' WHEN p < 80 THEN 'warning'
       ELSE 'success' END
  FROM (SELECT s.id_staff, COALESCE(TRUNC(CAST(COUNT(*) FILTER (y.asistio) AS DOUBLE)
               / NULLIF(COUNT(y.id_sesion), 0) * 100), 0) AS p
        FROM staff s JOIN rol r USING (id_rol) LEFT JOIN sesion_terapia y
          ON y.id_terapeuta = s.id_staff AND {_last_days('y.fecha_sesion', 30)}
        WHERE s.activo AND r.nivel_acceso = 2 GROUP BY 1))
SELECT grupo, banda, COUNT(*) AS total FROM b GROUP BY ALL"""),
    "severity_counts": _of("reporte_incidente residente staff", """
, x AS (SELECT i.severidad FROM reporte_incidente i JOIN residente USING (id_residente)
        JOIN staff USING (id_staff))
SELECT l.severidad, COUNT(x.severidad) AS total
FROM (SELECT UNNEST(['Alta', 'Media', 'Baja', 'Ninguna']) AS severidad) l
LEFT JOIN x USING (severidad) GROUP BY 1"""),
    "pending_head": _of(PENDING_TABLES, PENDING + """
SELECT *, GREATEST((SELECT COUNT(*) FROM pending) - 5, 0) AS restantes
FROM pending ORDER BY hora_programada, id_horario LIMIT 5"""),
    "constraint_violations": _of(ALL_TABLES, " UNION ALL ".join(
        f"SELECT '{t}' AS tabla, {rules.UNIQUE[t][0][0]} AS clave, '{r}' AS regla FROM {t} WHERE {bad}"
        for t, r, bad in _row_rule_sql())),
    "orphans": _of(ALL_TABLES, " UNION ALL ".join(
        f"SELECT '{t}' AS tabla, '{c}' AS columna, {c} AS valor, COUNT(*) AS filas FROM {t} WHERE {c} IS NOT NULL "
        f"AND {c} NOT IN (SELECT {k} FROM {p}) GROUP BY {c}" for t, c, p, k in _references())),
    "duplicates": _of(ALL_TABLES, " UNION ALL ".join(
        f"SELECT '{t}' AS tabla, '{c[0]}' AS columnas, {c[0]}::VARCHAR AS valor, COUNT(*) AS filas FROM {t} "
        f"WHERE {c[0]} IS NOT NULL GROUP BY {c[0]} HAVING COUNT(*) > 1"
        for t, sets in rules.UNIQUE.items() for c in sets)),
    "rule_report": _of(ALL_TABLES, ", r AS (" + " UNION ALL ".join([
        *(f"SELECT '{t}' AS tabla, '{r}' AS regla, COUNT(*) AS filas FROM {t} WHERE {bad}" for t, r, bad in _row_rule_sql()),
        *(f"SELECT '{t}', '{c[0]}_unico', COALESCE(SUM(n), 0)::BIGINT FROM (SELECT COUNT(*) AS n FROM {t} "
          f"WHERE {c[0]} IS NOT NULL GROUP BY {c[0]} HAVING COUNT(*) > 1)" for t, sets in rules.UNIQUE.items() for c in sets),
        *(f"SELECT '{t}', '{c}_referencia', COUNT(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p})"
          for t, c, p, k in _references())]) + ") SELECT tabla, regla, filas FROM r WHERE filas > 0"),
    "sessions_by_week": _of("sesion_terapia", """
SELECT CAST(date_trunc('week', fecha_sesion) AS DATE) AS semana, COUNT(*) AS sesiones,
       COUNT(DISTINCT id_residente) AS residentes FROM sesion_terapia GROUP BY 1"""),
    "table_round_trip": _of("checkin_estado_animo", "SELECT * FROM checkin_estado_animo"),
}
ORACLES["resident_by_id"] = f"SELECT * FROM ({ORACLES['resident_detail']}) WHERE id_residente = 7"
ORACLES |= {f"{name}_by_day": ORACLES[name] for name in BY_DAY}
