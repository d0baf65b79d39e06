"""Table changes over the derived care tables: requests drawn from the event
feed, their outcomes and the resulting rows."""

from __future__ import annotations

from checks.star import CARE, EVENTS_NOW, K, Derived, with_tables
from vigilia.plans import changes

# Requests, one per event. Each family holds bad rows on purpose.
REQUESTS = {
    "new_checkin": dict(source="events", columns=dict(
        change_id="event_id", id_residente="user_id + 1", id_cuidador=f"CAST({K} + 5 AS BIGINT)",
        puntaje="CAST(FLOOR(value) % 7 AS INT)", notas="event_type")),
    "new_resident": dict(source="events", columns=dict(
        change_id="event_id", nombre="event_type", apellidos="CAST(user_id AS STRING)",
        fecha_nacimiento="DATE '1930-01-01' + CAST(event_id % 15000 AS INT)",
        sexo="CASE WHEN event_type = 'view' THEN 'X' ELSE 'F' END", habitacion="'1'",
        diagnostico_principal="props", nivel_movilidad="'Asistido'",
        contacto_emergencia="event_type", tel_emergencia="'33'",
        id_cuidador=f"CASE WHEN event_type <> 'click' THEN CAST({K} + 5 AS BIGINT) END")),
    "new_staff": dict(source="events", columns=dict(
        change_id="event_id", nombre="event_type", apellidos="CAST(user_id AS STRING)",
        especialidad="'General'",
        email="CONCAT('s', CAST((user_id * 7 + event_id % 3) % 1100 AS STRING), '@example.org')",
        id_rol=f"CAST({K} % 7 AS BIGINT)",
        username=f"CONCAT('u', CAST(190 + user_id * 3 + {K} % 3 AS STRING))",
        password_hash="'x'")),
    "resident_edit": dict(source="events", columns=dict(
        change_id="event_id", actor_id="CASE WHEN user_id % 9 <> 0 THEN user_id END",
        id_residente="user_id * 11 + 1", habitacion=f"CAST({K} AS STRING)",
        diagnostico_principal="event_type",
        nivel_movilidad="CASE WHEN event_type = 'view' THEN 'Otro' ELSE 'Encamado' END",
        contacto_emergencia="'c'", tel_emergencia="'33'")),
    "session_edit": dict(source="events", columns=dict(
        change_id="event_id", id_sesion="(event_id * 3) % 20000", asistio="value < 30",
        notas="props")),
    "staff_toggle": dict(source="events", columns=dict(
        change_id="event_id", actor_id="user_id * 2", id_staff="(event_id * 7) % 130")),
    "incident_delete": dict(source="events", columns=dict(
        change_id="event_id", id_incidente="(event_id * 2) % 12000")),
    "session_delete": dict(source="events", columns=dict(
        change_id="event_id", id_sesion="event_id % 3000 + 1",
        id_terapeuta=f"CAST({K} + 1 AS BIGINT)")),
    "log_delete": dict(source="events", columns=dict(
        change_id="event_id", id_log="event_id * 3 + 5")),
    "discharge": dict(source="events", columns=dict(
        change_id="event_id", actor_id="user_id + 60", id_residente="user_id * 12")),
    "booking": dict(source="events", columns=dict(
        change_id="event_id", id_residente="user_id + 1", id_terapeuta=f"CAST({K} + 1 AS BIGINT)",
        id_sala=f"CAST((user_id * 3 + {K}) % 100 + 1 AS BIGINT)",
        fecha_sesion="CAST(date_trunc('minute', ts) AS {ts}) + INTERVAL '200' MINUTE",
        duracion_min=f"15 + {K} % 90", tipo_sesion="'Individual'")),
    "new_incident": dict(source="events", columns=dict(
        change_id="event_id", id_residente="user_id + 1", id_staff=f"CAST({K} + 5 AS BIGINT)",
        tipo="CASE WHEN event_type = 'signup' THEN 'Fuga' ELSE 'Otro' END", descripcion="props",
        severidad=f"CASE {K} % 4 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Media' WHEN 2 THEN 'Baja' ELSE 'Nula' END")),
    "new_access": dict(source="events", columns=dict(
        change_id="event_id", id_lector="user_id % 120 + 1", id_staff=f"CAST({K} + 5 AS BIGINT)",
        acceso_concedido="CASE WHEN value >= 60 THEN value < 100 END")),
    "new_audit": dict(source="events", columns=dict(
        change_id="event_id", id_usuario="user_id * 3", tabla_afectada="'staff'",
        operacion="CASE WHEN event_type = 'click' THEN 'MERGE' ELSE 'UPDATE' END", id_registro="event_id")),
    "staff_edit": dict(source="events", columns=dict(
        change_id="event_id", actor_id="user_id * 2", id_staff="(event_id * 7) % 130", nombre="event_type",
        apellidos="props", especialidad="'General'",
        email="CONCAT('s', CAST((event_id * 3) % 20011 AS STRING), '@example.org')",
        id_rol=f"CAST({K} % 7 AS BIGINT)")),
    "incident_edit": dict(source="events", columns=dict(
        change_id="event_id", id_incidente="(event_id * 2) % 12000",
        tipo="CASE WHEN event_type = 'signup' THEN 'Fuga' ELSE 'Caida' END", descripcion="event_type",
        severidad=f"CASE {K} % 4 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Media' WHEN 2 THEN 'Baja' ELSE 'Nula' END")),
    "scan": dict(source="events", columns=dict(
        change_id="event_id", codigo_tag="CONCAT('NFC-', CAST(user_id * 11 AS STRING))",
        id_staff=f"CAST({K} + 4 AS BIGINT)", escaneado_en="ts")),
}
ALL = CARE | REQUESTS


def _run(operation):
    def query(spark, sf_dir):
        return operation(Derived(spark, sf_dir, ALL))
    return query


def _of(names: str, body: str, recursive: bool = False) -> str:
    return with_tables(ALL, names, body, recursive)


QUERIES = {name: _run(f) for name, f in {
    "checkin_append": lambda t: changes.add_checkins(t, t["new_checkin"], EVENTS_NOW).outcome,
    "checkin_created": lambda t: changes.add_checkins(
        t, t["new_checkin"], EVENTS_NOW).created["checkin_estado_animo"],
    "resident_admission": lambda t: changes.admit_residents(
        t, t["new_resident"], EVENTS_NOW).outcome,
    "resident_assigned": lambda t: changes.admit_residents(
        t, t["new_resident"], EVENTS_NOW).created["asignacion"],
    "staff_hiring": lambda t: changes.hire_staff(t, t["new_staff"], EVENTS_NOW).outcome,
    "resident_update": lambda t: changes.update_residents(
        t, t["resident_edit"], EVENTS_NOW).outcome,
    "resident_updated": lambda t: changes.update_residents(
        t, t["resident_edit"], EVENTS_NOW).tables["residente"],
    "resident_update_audit": lambda t: changes.update_residents(
        t, t["resident_edit"], EVENTS_NOW).audit,
    "session_updated": lambda t: changes.update_sessions(
        t, t["session_edit"], EVENTS_NOW).tables["sesion_terapia"],
    "staff_toggled": lambda t: changes.toggle_staff(
        t, t["staff_toggle"], EVENTS_NOW).tables["staff"],
    "incident_deletion": lambda t: changes.delete_incidents(t, t["incident_delete"]).outcome,
    "session_deletion": lambda t: changes.delete_sessions(t, t["session_delete"]).outcome,
    "sessions_left": lambda t: changes.delete_sessions(
        t, t["session_delete"]).tables["sesion_terapia"],
    "protected_log": lambda t: changes.guard_deletes(
        t, "log_medicamento", "id_log", t["log_delete"]).outcome,
    "resident_discharge": lambda t: changes.discharge_residents(
        t, t["discharge"], "2022-05-01").outcome,
    "discharged_assignments": lambda t: changes.discharge_residents(
        t, t["discharge"], "2022-05-01").tables["asignacion"],
    "booking_conflicts": lambda t: changes.booking_conflicts(t["booking"], t["sesion_terapia"]),
    "booking_outcomes": lambda t: changes.book_sessions(t, t["booking"], EVENTS_NOW).outcome,
    "nearest_schedule": lambda t: changes.confirm_medication(t, t["scan"], EVENTS_NOW).outcome,
    "incident_append": lambda t: changes.add_incidents(t, t["new_incident"], EVENTS_NOW).outcome,
    "incident_created": lambda t: changes.add_incidents(
        t, t["new_incident"], EVENTS_NOW).created["reporte_incidente"],
    "access_append": lambda t: changes.add_accesses(t, t["new_access"], EVENTS_NOW).outcome,
    "access_created": lambda t: changes.add_accesses(t, t["new_access"], EVENTS_NOW).created["acceso_rfid"],
    "audit_append": lambda t: changes.add_audit(t, t["new_audit"], EVENTS_NOW).outcome,
    "audit_created": lambda t: changes.add_audit(t, t["new_audit"], EVENTS_NOW).created["log_auditoria"],
    "staff_update": lambda t: changes.update_staff(t, t["staff_edit"], EVENTS_NOW).outcome,
    "staff_update_audit": lambda t: changes.update_staff(t, t["staff_edit"], EVENTS_NOW).audit,
    "staff_updated": lambda t: changes.update_staff(t, t["staff_edit"], EVENTS_NOW).tables["staff"],
    "incident_update": lambda t: changes.update_incidents(t, t["incident_edit"], EVENTS_NOW).outcome,
    "incident_updated": lambda t: changes.update_incidents(
        t, t["incident_edit"], EVENTS_NOW).tables["reporte_incidente"],
    "staff_toggle_outcome": lambda t: changes.toggle_staff(t, t["staff_toggle"], EVENTS_NOW).outcome,
    "staff_toggle_audit": lambda t: changes.toggle_staff(t, t["staff_toggle"], EVENTS_NOW).audit,
    "discharge_audit": lambda t: changes.discharge_residents(t, t["discharge"], "2022-05-01").audit,
    "nearest_schedule_events": lambda t: changes.confirm_medication(
        t, t["scan"], EVENTS_NOW).created["nfc_evento"],
    "nearest_schedule_logs": lambda t: changes.confirm_medication(
        t, t["scan"], EVENTS_NOW).created["log_medicamento"],
}.items()}

_CHECKIN = """, c AS (
SELECT n.*, concat_ws(', ', IF(n.puntaje NOT BETWEEN 1 AND 5, 'puntaje_rango', NULL),
       IF(n.id_cuidador NOT IN (SELECT id_staff FROM staff), 'id_cuidador_referencia', NULL)) AS bad
FROM new_checkin n)"""
_ADMIT = """, c AS (
SELECT n.*, concat_ws(', ', IF(n.sexo NOT IN ('M', 'F'), 'sexo_valor', NULL),
       IF(n.fecha_nacimiento > DATE '1964-01-30', 'edad_minima', NULL)) AS bad,
       n.id_cuidador NOT IN (SELECT id_staff FROM staff) AS lost
FROM new_resident n)
, ok AS (SELECT *, (SELECT MAX(id_residente) FROM residente)
                   + ROW_NUMBER() OVER (ORDER BY change_id) AS id_residente
         FROM c WHERE bad = '' AND NOT COALESCE(lost, FALSE))"""
_EDIT = """, c AS (
SELECT e.*, CASE WHEN e.id_residente NOT IN (SELECT id_residente FROM residente WHERE activo)
            THEN 'Residente no encontrado o inactivo.'
            WHEN e.nivel_movilidad = 'Otro' THEN 'Error: movilidad_valor'
            WHEN COALESCE(e.actor_id, 0) NOT IN (SELECT id_usuario FROM usuario_sistema)
            THEN 'Error: id_usuario_referencia' END AS bad
FROM resident_edit e)"""
_LEAVE = """, c AS (
SELECT d.*, CASE WHEN d.id_residente NOT IN (SELECT id_residente FROM residente)
            THEN 'Residente no encontrado.'
            WHEN d.id_residente IN (SELECT id_residente FROM asignacion
                                    WHERE fecha_fin IS NULL AND fecha_inicio >= DATE '2022-05-01')
            THEN 'Error: fechas_orden'
            WHEN d.actor_id NOT IN (SELECT id_usuario FROM usuario_sistema)
            THEN 'Error: id_usuario_referencia' END AS bad
FROM discharge d)"""
_TOGGLE = """, c AS (
SELECT f.*, CASE WHEN f.id_staff NOT IN (SELECT id_staff FROM staff) THEN 'Personal no encontrado.'
            WHEN COALESCE(f.actor_id, 0) NOT IN (SELECT id_usuario FROM usuario_sistema)
            THEN 'Error: id_usuario_referencia' END AS bad
FROM staff_toggle f)"""
_INCIDENT = """, c AS (
SELECT n.*, concat_ws(', ', IF(n.tipo = 'Fuga', 'tipo_valor', NULL), IF(n.severidad = 'Nula', 'severidad_valor', NULL),
       IF(n.id_residente NOT IN (SELECT id_residente FROM residente), 'id_residente_referencia', NULL),
       IF(n.id_staff NOT IN (SELECT id_staff FROM staff), 'id_staff_referencia', NULL)) AS bad
FROM new_incident n)"""
_ACCESS = """, c AS (
SELECT n.*, concat_ws(', ', IF(n.id_lector NOT IN (SELECT id_lector FROM lector_rfid), 'id_lector_referencia', NULL),
       IF(n.id_staff NOT IN (SELECT id_staff FROM staff), 'id_staff_referencia', NULL)) AS bad
FROM new_access n)"""
_AUDIT = """, c AS (
SELECT n.*, concat_ws(', ', IF(n.operacion = 'MERGE', 'operacion_valor', NULL),
       IF(n.id_usuario NOT IN (SELECT id_usuario FROM usuario_sistema), 'id_usuario_referencia', NULL)) AS bad
FROM new_audit n)"""
_STAFF = """, first AS (SELECT email, arg_min(id_staff, change_id) AS id_staff FROM staff_edit GROUP BY email)
, c AS (
SELECT e.*, CASE WHEN e.id_staff NOT IN (SELECT id_staff FROM staff) THEN 'Personal no encontrado.'
            WHEN e.id_rol NOT IN (SELECT id_rol FROM rol) THEN 'Error: id_rol_referencia'
            WHEN COALESCE(e.actor_id, 0) NOT IN (SELECT id_usuario FROM usuario_sistema)
            THEN 'Error: id_usuario_referencia'
            WHEN h.id_staff <> e.id_staff OR f.id_staff <> e.id_staff THEN 'Error: email_unico' END AS bad
FROM staff_edit e LEFT JOIN staff h ON h.email = e.email LEFT JOIN first f ON f.email = e.email)"""
_STAFF_TABLES = "staff_edit staff rol usuario_sistema"
_INCIDENT_EDIT = """, c AS (
SELECT e.*, CASE WHEN e.id_incidente NOT IN (SELECT id_incidente FROM reporte_incidente)
            THEN 'Incidente no encontrado.'
            WHEN e.tipo = 'Fuga' OR e.severidad = 'Nula'
            THEN 'Error: ' || concat_ws(', ', IF(e.tipo = 'Fuga', 'tipo_valor', NULL),
                                        IF(e.severidad = 'Nula', 'severidad_valor', NULL)) END AS bad
FROM incident_edit e)"""

# Requests of ``live`` in turn: state 1 wins, 2 loses, 0 still has an open rival among ``pairs`` (earlier a, later b).
_IN_TURN = """
, turn AS (
SELECT change_id, 0 AS state, 0 AS round FROM live
UNION ALL
SELECT t.change_id, CASE WHEN t.state > 0 THEN t.state WHEN r.beaten THEN 2 WHEN r.waits THEN 0 ELSE 1 END, t.round + 1
FROM turn t LEFT JOIN (SELECT p.b, bool_or(x.state = 1) AS beaten, bool_or(x.state = 0) AS waits
                       FROM pairs p JOIN turn x ON x.change_id = p.a GROUP BY p.b) r ON r.b = t.change_id
WHERE EXISTS (SELECT 1 FROM turn WHERE state = 0))
, won AS (SELECT change_id FROM turn WHERE state = 1 AND round = (SELECT MAX(round) FROM turn))"""
_BOOK = """, x AS (SELECT id_terapeuta, id_sala, fecha_sesion, fecha_sesion + duracion_min * INTERVAL '1' MINUTE AS until
       FROM sesion_terapia)
, n AS (SELECT b.*, fecha_sesion + duracion_min * INTERVAL '1' MINUTE AS until,
               concat_ws(', ', IF(id_residente NOT IN (SELECT id_residente FROM residente), 'id_residente_referencia', NULL),
                         IF(id_terapeuta NOT IN (SELECT id_staff FROM staff), 'id_terapeuta_referencia', NULL),
                         IF(id_sala NOT IN (SELECT id_sala FROM sala), 'id_sala_referencia', NULL)) AS bad FROM booking b)
, held AS (SELECT n.*, EXISTS (SELECT 1 FROM x WHERE x.id_terapeuta = n.id_terapeuta
                               AND x.fecha_sesion < n.until AND x.until > n.fecha_sesion) AS therapist,
                  EXISTS (SELECT 1 FROM x WHERE x.id_sala = n.id_sala
                          AND x.fecha_sesion < n.until AND x.until > n.fecha_sesion) AS room FROM n)
, live AS (SELECT * FROM held WHERE bad = '' AND NOT therapist AND NOT room)
, pairs AS (
SELECT e.change_id AS a, l.change_id AS b FROM live e JOIN live l ON e.id_terapeuta = l.id_terapeuta
 AND e.change_id < l.change_id AND e.fecha_sesion < l.until AND e.until > l.fecha_sesion
UNION
SELECT e.change_id, l.change_id FROM live e JOIN live l ON e.id_sala = l.id_sala
 AND e.change_id < l.change_id AND e.fecha_sesion < l.until AND e.until > l.fecha_sesion)""" + _IN_TURN + """
, kept AS (SELECT * FROM live WHERE change_id IN (SELECT change_id FROM won))
, c AS (SELECT h.change_id, CASE
    WHEN therapist OR EXISTS (SELECT 1 FROM kept k WHERE k.id_terapeuta = h.id_terapeuta AND k.change_id < h.change_id
                              AND k.fecha_sesion < h.until AND k.until > h.fecha_sesion)
    THEN 'El terapeuta ya tiene una sesión en ese horario.'
    WHEN room OR EXISTS (SELECT 1 FROM kept k WHERE k.id_sala = h.id_sala AND k.change_id < h.change_id
                         AND k.fecha_sesion < h.until AND k.until > h.fecha_sesion)
    THEN 'La sala ya está ocupada en ese horario.'
    WHEN bad <> '' THEN 'Error: ' || bad END AS bad FROM held h)"""
_HIRE = """, n AS (
SELECT s.*, CASE WHEN id_rol NOT IN (SELECT id_rol FROM rol) THEN 'id_rol_referencia'
            WHEN email IN (SELECT email FROM staff) THEN 'email_unico'
            WHEN username IN (SELECT username FROM usuario_sistema) THEN 'username_unico' END AS bad FROM new_staff s)
, live AS (SELECT * FROM n WHERE bad IS NULL)
, pairs AS (
SELECT e.change_id AS a, l.change_id AS b FROM live e JOIN live l ON e.email = l.email AND e.change_id < l.change_id
UNION
SELECT e.change_id, l.change_id FROM live e JOIN live l ON e.username = l.username AND e.change_id < l.change_id)
""" + _IN_TURN + """
, ids AS (SELECT change_id, (SELECT MAX(id_staff) FROM staff) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_staff
          FROM won)"""


def _audited(table: str, key: str, at: str) -> str:
    return (f" SELECT actor_id AS id_usuario, '{table}' AS tabla_afectada, 'UPDATE' AS operacion, {key} AS id_registro, "
            f"CAST(NULL AS VARCHAR) AS ip_origen, TIMESTAMP '{at}' AS timestamp_operacion FROM c WHERE bad IS NULL")


def _said(message: str) -> str:
    return (" SELECT change_id, CAST(bad = '' AS INTEGER) AS ok, "
            f"IF(bad = '', '{message}', 'Error: ' || bad) AS msg FROM c")


_OUTCOME = " SELECT change_id, CAST(bad IS NULL AS INTEGER) AS ok, COALESCE(bad, '{}') AS msg FROM c"
_SCAN = """, c AS (
SELECT s.*, g.id_tag, g.id_residente, h.id_horario,
       abs(epoch_us(s.escaneado_en) % 86400000000 - CAST(h.hora_programada AS BIGINT) * 1000000) AS gap
FROM scan s LEFT JOIN nfc_tag g USING (codigo_tag)
LEFT JOIN horario_medicamento h ON h.id_residente = g.id_residente AND h.activo
     AND LEAST(abs(epoch_us(s.escaneado_en) % 86400000000 - CAST(h.hora_programada AS BIGINT) * 1000000),
               86400000000 - abs(epoch_us(s.escaneado_en) % 86400000000
                                 - CAST(h.hora_programada AS BIGINT) * 1000000)) <= 7200000000
QUALIFY ROW_NUMBER() OVER (PARTITION BY s.change_id
                           ORDER BY LEAST(gap, 86400000000 - gap), h.id_horario) = 1)
, r AS (SELECT *, CASE WHEN id_tag IS NULL THEN 'Tag NFC no registrado.'
                  WHEN id_horario IS NULL
                  THEN 'No se encontró horario de medicamento activo para esta hora.'
                  WHEN id_staff NOT IN (SELECT id_staff FROM staff)
                  THEN 'Error: id_cuidador_referencia' END AS bad FROM c)"""
_SCAN_TABLES = "scan nfc_tag horario_medicamento staff"

ORACLES = {
    "checkin_append": _of("new_checkin staff", _CHECKIN + """
SELECT change_id, CAST(bad = '' AS INTEGER) AS ok,
       IF(bad = '', 'Check-in registrado.', 'Error: ' || bad) AS msg FROM c"""),
    "checkin_created": _of("new_checkin staff checkin_estado_animo", _CHECKIN + f"""
SELECT (SELECT MAX(id_checkin) FROM checkin_estado_animo)
       + ROW_NUMBER() OVER (ORDER BY change_id) AS id_checkin,
       id_residente, id_cuidador, TIMESTAMP '{EVENTS_NOW}' AS fecha_registro, puntaje, notas
FROM c WHERE bad = ''"""),
    "resident_admission": _of("new_resident staff residente", _ADMIT + """
SELECT c.change_id, CAST(ok.change_id IS NOT NULL AS INTEGER) AS ok,
       CASE WHEN ok.change_id IS NOT NULL THEN 'Residente registrado con ID ' || ok.id_residente
            WHEN c.bad <> '' THEN 'Error: ' || c.bad ELSE 'Error: id_staff_referencia' END AS msg
FROM c LEFT JOIN ok USING (change_id)"""),
    "resident_assigned": _of("new_resident staff residente asignacion", _ADMIT + f"""
SELECT (SELECT MAX(id_asignacion) FROM asignacion)
       + ROW_NUMBER() OVER (ORDER BY change_id) AS id_asignacion, id_residente,
       id_cuidador AS id_staff, 'Cuidador' AS tipo_rol, DATE '{EVENTS_NOW[:10]}' AS fecha_inicio,
       CAST(NULL AS DATE) AS fecha_fin, TRUE AS es_principal
FROM ok WHERE id_cuidador IS NOT NULL"""),
    "resident_update": _of("resident_edit residente usuario_sistema",
                           _EDIT + _OUTCOME.format("Residente actualizado.")),
    "resident_updated": _of("resident_edit residente usuario_sistema", _EDIT + """
, n AS (SELECT * FROM c WHERE bad IS NULL
        QUALIFY ROW_NUMBER() OVER (PARTITION BY id_residente ORDER BY change_id DESC) = 1)
SELECT r.* REPLACE (
    IF(n.change_id IS NULL, r.habitacion, n.habitacion) AS habitacion,
    IF(n.change_id IS NULL, r.diagnostico_principal, n.diagnostico_principal) AS diagnostico_principal,
    IF(n.change_id IS NULL, r.nivel_movilidad, n.nivel_movilidad) AS nivel_movilidad,
    IF(n.change_id IS NULL, r.contacto_emergencia, n.contacto_emergencia) AS contacto_emergencia,
    IF(n.change_id IS NULL, r.tel_emergencia, n.tel_emergencia) AS tel_emergencia)
FROM residente r LEFT JOIN n USING (id_residente)"""),
    "resident_update_audit": _of("resident_edit residente usuario_sistema", _EDIT + f"""
SELECT actor_id AS id_usuario, 'residente' AS tabla_afectada, 'UPDATE' AS operacion,
       id_residente AS id_registro, CAST(NULL AS VARCHAR) AS ip_origen,
       TIMESTAMP '{EVENTS_NOW}' AS timestamp_operacion FROM c WHERE bad IS NULL"""),
    "session_updated": _of("session_edit sesion_terapia", """
, n AS (SELECT id_sesion, arg_max(asistio, change_id) AS asistio, arg_max(notas, change_id) AS notas
        FROM session_edit GROUP BY 1)
SELECT x.* REPLACE (COALESCE(n.asistio, x.asistio) AS asistio, COALESCE(n.notas, x.notas) AS notas)
FROM sesion_terapia x LEFT JOIN n USING (id_sesion)"""),
    "staff_toggled": _of("staff_toggle staff usuario_sistema", """
SELECT s.* REPLACE (s.activo <> (COALESCE(f.n, 0) % 2 = 1) AS activo)
FROM staff s LEFT JOIN (SELECT id_staff, COUNT(*) AS n FROM staff_toggle
                        WHERE actor_id IN (SELECT id_usuario FROM usuario_sistema) GROUP BY 1) f
USING (id_staff)"""),
    "incident_deletion": _of("incident_delete reporte_incidente", """
, c AS (SELECT *, IF(id_incidente IN (SELECT id_incidente FROM reporte_incidente)
                     AND ROW_NUMBER() OVER (PARTITION BY id_incidente ORDER BY change_id) = 1,
                     NULL, 'Incidente no encontrado.') AS bad FROM incident_delete)"""
                             + _OUTCOME.format("Incidente eliminado.")),
    "session_deletion": _of("session_delete sesion_terapia", """
, c AS (SELECT d.*, IF((d.id_sesion, d.id_terapeuta) IN
                        (SELECT (id_sesion, id_terapeuta) FROM sesion_terapia)
                       AND ROW_NUMBER() OVER (PARTITION BY d.id_sesion, d.id_terapeuta
                                              ORDER BY change_id) = 1, NULL,
                     'Sesión no encontrada o no pertenece a este terapeuta.') AS bad
        FROM session_delete d)""" + _OUTCOME.format("Sesión eliminada.")),
    "sessions_left": _of("session_delete sesion_terapia", """
SELECT x.* FROM sesion_terapia x WHERE NOT EXISTS (SELECT 1 FROM session_delete d
 WHERE d.id_sesion = x.id_sesion AND d.id_terapeuta = x.id_terapeuta)"""),
    "protected_log": _of("log_delete", """
SELECT change_id, 0 AS ok,
       'Error: El log de medicamentos es inmutable. No se permite DELETE.' AS msg FROM log_delete"""),
    "resident_discharge": _of("discharge residente asignacion usuario_sistema",
                              _LEAVE + _OUTCOME.format("Residente dado de baja correctamente.")),
    "discharged_assignments": _of("discharge residente asignacion usuario_sistema", _LEAVE + """
SELECT a.* REPLACE (COALESCE(a.fecha_fin, IF(a.id_residente IN
    (SELECT id_residente FROM c WHERE bad IS NULL), DATE '2022-05-01', NULL)) AS fecha_fin)
FROM asignacion a"""),
    "booking_conflicts": _of("booking sesion_terapia", """
, x AS (SELECT *, fecha_sesion + duracion_min * INTERVAL '1' MINUTE AS until FROM sesion_terapia)
SELECT b.*,
       (SELECT COUNT(*) FROM x WHERE x.id_terapeuta = b.id_terapeuta
        AND x.fecha_sesion < b.fecha_sesion + b.duracion_min * INTERVAL '1' MINUTE
        AND x.until > b.fecha_sesion) AS conflictos_terapeuta,
       (SELECT COUNT(*) FROM x WHERE x.id_sala = b.id_sala
        AND x.fecha_sesion < b.fecha_sesion + b.duracion_min * INTERVAL '1' MINUTE
        AND x.until > b.fecha_sesion) AS conflictos_sala
FROM booking b"""),
    "booking_outcomes": _of("booking sesion_terapia residente staff sala",
                            _BOOK + _OUTCOME.format("Sesión registrada correctamente."), recursive=True),
    "staff_hiring": _of("new_staff staff rol usuario_sistema", _HIRE + """
SELECT n.change_id, CAST(ids.id_staff IS NOT NULL AS INTEGER) AS ok,
       COALESCE('Personal registrado con ID ' || ids.id_staff,
                'Error: ' || COALESCE(n.bad, 'email_o_username_unico')) AS msg
FROM n LEFT JOIN ids USING (change_id)""", recursive=True),
    "nearest_schedule": _of(_SCAN_TABLES, _SCAN + """
SELECT change_id, CAST(bad IS NULL AS INTEGER) AS ok,
       COALESCE(bad, 'Medicamento registrado para residente ID ' || id_residente) AS msg FROM r"""),
    "incident_append": _of("new_incident residente staff", _INCIDENT + _said("Incidente registrado.")),
    "incident_created": _of("new_incident residente staff reporte_incidente", _INCIDENT + f"""
SELECT (SELECT MAX(id_incidente) FROM reporte_incidente) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_incidente,
       id_residente, id_staff, TIMESTAMP '{EVENTS_NOW}' AS fecha, tipo, descripcion, severidad
FROM c WHERE bad = ''"""),
    "access_append": _of("new_access lector_rfid staff", _ACCESS + _said("Acceso registrado.")),
    "access_created": _of("new_access lector_rfid staff acceso_rfid", _ACCESS + f"""
SELECT (SELECT MAX(id_acceso) FROM acceso_rfid) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_acceso,
       id_lector, id_staff, TIMESTAMP '{EVENTS_NOW}' AS accedido_en, COALESCE(acceso_concedido, TRUE) AS acceso_concedido
FROM c WHERE bad = ''"""),
    "audit_append": _of("new_audit usuario_sistema", _AUDIT + _said("Auditoría registrada.")),
    "audit_created": _of("new_audit usuario_sistema log_auditoria", _AUDIT + f"""
SELECT (SELECT MAX(id_log) FROM log_auditoria) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_log, id_usuario,
       tabla_afectada, operacion, id_registro, CAST(NULL AS VARCHAR) AS ip_origen,
       TIMESTAMP '{EVENTS_NOW}' AS timestamp_operacion FROM c WHERE bad = ''"""),
    "staff_update": _of(_STAFF_TABLES, _STAFF + _OUTCOME.format("Personal actualizado.")),
    "staff_update_audit": _of(_STAFF_TABLES, _STAFF + _audited("staff", "id_staff", EVENTS_NOW)),
    "staff_updated": _of(_STAFF_TABLES, _STAFF + """
, n AS (SELECT * FROM c WHERE bad IS NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY id_staff ORDER BY change_id DESC) = 1)
SELECT s.* REPLACE (COALESCE(n.nombre, s.nombre) AS nombre, COALESCE(n.apellidos, s.apellidos) AS apellidos,
    COALESCE(n.especialidad, s.especialidad) AS especialidad, COALESCE(n.email, s.email) AS email,
    COALESCE(n.id_rol, s.id_rol) AS id_rol) FROM staff s LEFT JOIN n USING (id_staff)"""),
    "incident_update": _of("incident_edit reporte_incidente",
                           _INCIDENT_EDIT + _OUTCOME.format("Incidente actualizado.")),
    "incident_updated": _of("incident_edit reporte_incidente", _INCIDENT_EDIT + """
, n AS (SELECT * FROM c WHERE bad IS NULL
        QUALIFY ROW_NUMBER() OVER (PARTITION BY id_incidente ORDER BY change_id DESC) = 1)
SELECT r.* REPLACE (COALESCE(n.tipo, r.tipo) AS tipo, COALESCE(n.descripcion, r.descripcion) AS descripcion,
    COALESCE(n.severidad, r.severidad) AS severidad) FROM reporte_incidente r LEFT JOIN n USING (id_incidente)"""),
    "staff_toggle_outcome": _of("staff_toggle staff usuario_sistema",
                                _TOGGLE + _OUTCOME.format("Estado del personal actualizado.")),
    "staff_toggle_audit": _of("staff_toggle staff usuario_sistema", _TOGGLE + _audited("staff", "id_staff", EVENTS_NOW)),
    "discharge_audit": _of("discharge residente asignacion usuario_sistema",
                           _LEAVE + _audited("residente", "id_residente", "2022-05-01")),
    "nearest_schedule_events": _of(_SCAN_TABLES + " log_medicamento nfc_evento", _SCAN + """
SELECT (SELECT MAX(id_evento) FROM nfc_evento) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_evento, id_tag, id_staff,
       escaneado_en, (SELECT MAX(id_log) FROM log_medicamento) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_log_med
FROM r WHERE bad IS NULL"""),
    "nearest_schedule_logs": _of(_SCAN_TABLES + " log_medicamento", _SCAN + """
SELECT (SELECT MAX(id_log) FROM log_medicamento) + ROW_NUMBER() OVER (ORDER BY change_id) AS id_log,
       id_horario, id_staff AS id_cuidador, escaneado_en AS fecha_administracion,
       CAST(NULL AS VARCHAR) AS incidente FROM r WHERE bad IS NULL"""),
}
