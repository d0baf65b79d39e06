"""Q1-Q17 and the as-of join over the derived clinic tables, with their SQL."""

from __future__ import annotations

from checks.star import CLINIC, EVENTS_NOW, ORDERS_NOW, clinic, with_tables
from vigilia.operators.sequence import asof_join
from vigilia.plans import alerts, clinic as q


def mean(x: str, digits: int) -> str:
    return f"CAST(ROUND(CAST(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def rounded(x: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def percent(part: str, whole: str) -> str:
    return rounded(f"100.0 * CAST({part} AS DOUBLE) / NULLIF({whole}, 0)", 1)


def micros(earlier: str, later: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier}))"


def _of(names: str, body: str, recursive: bool = False) -> str:
    return with_tables(CLINIC, names, body, recursive)


NOW = f"TIMESTAMP '{ORDERS_NOW}'"
EV = f"TIMESTAMP '{EVENTS_NOW}'"
PERSON = "p.nombre || ' ' || p.apellidos AS paciente"
LATEST_RISK = (", risk AS (SELECT id_paciente, nivel_severidad FROM alerta_riesgo QUALIFY "
               "ROW_NUMBER() OVER (PARTITION BY id_paciente ORDER BY fecha_generacion DESC, "
               "id_alerta DESC) = 1)")


def _alerts_with_assessment(spark, d):
    t = clinic(spark, d)
    return asof_join(
        t["alerta_riesgo"].select("id_alerta", "id_paciente", "fecha_generacion"),
        t["aplicacion_escala"], ["id_paciente"], "fecha_generacion", "fecha_aplicacion",
        "id_aplicacion", ["id_aplicacion", "puntaje_total"])


QUERIES = {
    "monthly_trend": lambda s, d: q.mood_trend(clinic(s, d)),
    "score_delta": lambda s, d: q.score_change(clinic(s, d), ordered=False),
    "unattended_alerts": lambda s, d: q.unattended_severe_alerts(clinic(s, d), ORDERS_NOW),
    "visit_regularity": lambda s, d: q.visit_regularity(clinic(s, d), ORDERS_NOW),
    "workload": lambda s, d: q.workload(clinic(s, d)),
    "workload_dedup": lambda s, d: q.workload(clinic(s, d), dedup=True),
    "resolution_rate": lambda s, d: q.alert_resolution(clinic(s, d)),
    "segment_severity_share": lambda s, d: q.diagnosis_severity(clinic(s, d)),
    "lapsed_patients": lambda s, d: q.lapsed_patients(clinic(s, d), ORDERS_NOW),
    "recent_out_of_zone": lambda s, d: q.out_of_zone(clinic(s, d), EVENTS_NOW),
    "zone_stay": lambda s, d: q.zone_stay(clinic(s, d)),
    "zone_stay_paired": lambda s, d: q.zone_stay(clinic(s, d), paired=True),
    "silent_devices": lambda s, d: q.silent_devices(clinic(s, d), EVENTS_NOW),
    "feed_summary_48h": lambda s, d: q.feed_summary(clinic(s, d), EVENTS_NOW),
    "monthly_kpi": lambda s, d: q.monthly_kpis(clinic(s, d)),
    "scale_distribution": lambda s, d: q.scale_distribution(clinic(s, d)),
    "audit_activity": lambda s, d: q.audit_activity(clinic(s, d)),
    "monthly_report": lambda s, d: q.monthly_report(clinic(s, d), ORDERS_NOW, 2000, 2),
    "monthly_report_current": lambda s, d: q.monthly_report(clinic(s, d), ORDERS_NOW),
    "adherence_index": lambda s, d: q.adherence_index(
        clinic(s, d), "1998-01-01", "2000-12-31", 6),
    "zone_exit_audit": lambda s, d: alerts.zone_exit_audit(
        alerts.zone_exit_alerts(clinic(s, d)["evento_gps"], clinic(s, d))),
    "assessment_alerts": lambda s, d: alerts.assessment_alerts(clinic(s, d)["aplicacion_escala"]),
    "zone_exit_alerts": lambda s, d: alerts.zone_exit_alerts(
        clinic(s, d)["evento_gps"], clinic(s, d)),
    "asof_assessment": _alerts_with_assessment,
}

_WORKLOAD = """
SELECT w.id_profesional, w.nombre || ' ' || w.apellidos AS profesional, w.especialidad,
       rol.nombre_rol, COUNT(DISTINCT s.id_sesion) AS total_sesiones,
       COUNT(DISTINCT s.id_paciente) AS pacientes_atendidos, {minutes} AS minutos_totales,
       {mean} AS duracion_promedio_min, {scales} AS escalas_aplicadas
FROM profesional w JOIN rol USING (id_rol)
LEFT JOIN sesion_psicologica s ON s.id_profesional = w.id_profesional
{join}
WHERE w.activo GROUP BY w.id_profesional, profesional, w.especialidad, rol.nombre_rol"""
_WORK_TABLES = "profesional rol sesion_psicologica aplicacion_escala"

FIRED = """
, risky AS (SELECT {key}, {ts} AS moment, {columns} FROM {table} WHERE {condition})
, fired AS (
    SELECT {key}, MIN(moment) AS moment FROM risky GROUP BY {key}
    UNION ALL
    SELECT {fkey}, MIN(r.moment) FROM fired f JOIN risky r ON {same}
    WHERE r.moment > f.moment + INTERVAL '{hours}' HOUR GROUP BY {fkey}, f.moment)
"""

ORACLES = {
    "monthly_trend": _of("paciente sesion_psicologica", f"""
SELECT p.id_paciente, {PERSON}, strftime(s.fecha_sesion, '%Y-%m') AS mes,
       COUNT(*) AS total_sesiones, {mean('s.estado_emoc_inicio', 2)} AS promedio_emoc_inicio,
       {mean('s.estado_emoc_fin', 2)} AS promedio_emoc_fin,
       {mean('(s.estado_emoc_fin - s.estado_emoc_inicio)', 2)} AS mejora_promedio
FROM sesion_psicologica s JOIN paciente p USING (id_paciente)
WHERE s.estado_emoc_inicio + s.estado_emoc_fin IS NOT NULL
GROUP BY p.id_paciente, paciente, mes"""),
    "score_delta": _of("paciente aplicacion_escala escala_clinica", f"""
SELECT {PERSON}, x.id_escala, e.nombre_escala, strftime(x.fecha_aplicacion, '%Y-%m-%d') AS fecha,
       x.puntaje_total, x.nivel_riesgo, x.puntaje_total - x.previo AS delta_puntaje
FROM (SELECT *, LAG(puntaje_total) OVER (PARTITION BY id_paciente, id_escala
                                         ORDER BY fecha_aplicacion, id_aplicacion) AS previo
      FROM aplicacion_escala) x
JOIN paciente p USING (id_paciente) JOIN escala_clinica e USING (id_escala)"""),
    "unattended_alerts": _of("paciente alerta_riesgo", f"""
SELECT p.id_paciente, {PERSON}, p.diagnostico_principal, g.n AS alertas_graves_sin_atender,
       g.first AS alerta_mas_antigua, g.last AS alerta_mas_reciente,
       {micros('g.first', NOW)} / 3600000000.0 AS horas_sin_atencion
FROM (SELECT id_paciente, COUNT(*) AS n, MIN(fecha_generacion) AS first,
             MAX(fecha_generacion) AS last
      FROM alerta_riesgo WHERE id_prof_atiende IS NULL AND nivel_severidad = 'Grave'
      AND estado_alerta = 'Activa' GROUP BY id_paciente) g JOIN paciente p USING (id_paciente)"""),
    "visit_regularity": _of("paciente sesion_psicologica", f"""
SELECT p.id_paciente, {PERSON}, p.diagnostico_principal, COUNT(s.id_sesion) AS total_sesiones,
       MIN(s.fecha_sesion) AS primera_sesion, MAX(s.fecha_sesion) AS ultima_sesion,
       {rounded(micros('MIN(s.fecha_sesion)', 'MAX(s.fecha_sesion)')
                + ' / 86400000000.0 / NULLIF(COUNT(s.id_sesion) - 1, 0)', 1)}
           AS dias_promedio_entre_sesiones,
       CAST(datesub('day', MAX(s.fecha_sesion), {NOW}) AS INTEGER) AS dias_sin_sesion
FROM paciente p LEFT JOIN sesion_psicologica s ON s.id_paciente = p.id_paciente
GROUP BY p.id_paciente, paciente, p.diagnostico_principal"""),
    # The join fans sessions out over assessments, as the report defines it.
    "workload": _of(_WORK_TABLES, _WORKLOAD.format(
        minutes="CAST(SUM(s.duracion_min) AS BIGINT)", mean=mean("s.duracion_min", 1),
        scales="COUNT(DISTINCT a.id_aplicacion)",
        join="LEFT JOIN aplicacion_escala a ON a.id_profesional = w.id_profesional")),
    "workload_dedup": _of(_WORK_TABLES, _WORKLOAD.format(
        minutes="CAST(SUM(s.duracion_min) AS BIGINT)", mean=mean("s.duracion_min", 1),
        scales="(SELECT COUNT(*) FROM aplicacion_escala a WHERE a.id_profesional = w.id_profesional)",
        join="")),
    "resolution_rate": _of("profesional alerta_riesgo", f"""
SELECT w.nombre || ' ' || w.apellidos AS profesional, w.especialidad,
       COUNT(*) AS alertas_atendidas,
       COUNT(*) FILTER (estado_alerta = 'Cerrada') AS cerradas,
       COUNT(*) FILTER (estado_alerta = 'Revisada') AS revisadas,
       COUNT(*) FILTER (estado_alerta = 'Activa') AS aun_activas,
       {percent("COUNT(*) FILTER (estado_alerta = 'Cerrada')", 'COUNT(*)')} AS tasa_resolucion_pct,
       {rounded(f"CAST(SUM({micros('fecha_generacion', 'fecha_resolucion')}) FILTER "
                "(estado_alerta = 'Cerrada') AS DOUBLE) / NULLIF(COUNT(*) FILTER "
                "(estado_alerta = 'Cerrada'), 0) / 3600000000.0", 2)} AS horas_promedio_resolucion
FROM alerta_riesgo a JOIN profesional w ON w.id_profesional = a.id_prof_atiende
GROUP BY w.id_profesional, profesional, w.especialidad"""),
    "segment_severity_share": _of("paciente alerta_riesgo", LATEST_RISK + f"""
, c AS (SELECT p.diagnostico_principal, risk.nivel_severidad, COUNT(*) AS n
        FROM paciente p LEFT JOIN risk USING (id_paciente) GROUP BY 1, 2)
SELECT c.diagnostico_principal, c.nivel_severidad, c.n AS total_pacientes,
       {percent('c.n', 'd.n')} AS pct_dentro_diagnostico
FROM c JOIN (SELECT diagnostico_principal, SUM(n) AS n FROM c GROUP BY 1) d
USING (diagnostico_principal)"""),
    "lapsed_patients": _of("paciente sesion_psicologica cuidador alerta_riesgo", LATEST_RISK + f"""
SELECT p.id_paciente, {PERSON}, p.diagnostico_principal,
       c.nombre || ' ' || c.apellidos AS cuidador_responsable, c.telefono AS tel_cuidador,
       s.last AS ultima_sesion,
       CAST(datesub('day', s.last, {NOW}) AS INTEGER) AS dias_sin_sesion,
       risk.nivel_severidad AS riesgo_actual
FROM paciente p
LEFT JOIN (SELECT id_paciente, MAX(fecha_sesion) AS last FROM sesion_psicologica GROUP BY 1) s
     USING (id_paciente)
LEFT JOIN cuidador c ON c.id_cuidador = p.id_cuidador
LEFT JOIN risk ON risk.id_paciente = p.id_paciente
WHERE COALESCE(s.last < {NOW} - INTERVAL '30' DAY, TRUE)"""),
    "recent_out_of_zone": _of("evento_gps dispositivo_iot paciente cuidador", f"""
SELECT p.id_paciente, {PERSON}, p.diagnostico_principal,
       c.nombre || ' ' || c.apellidos AS cuidador, c.telefono, v.tipo_dispositivo,
       v.identificador_hw, g.latitud, g.longitud,
       strftime(g.timestamp_evento, '%d %b %Y %H:%M:%S') AS timestamp_salida,
       {rounded(micros('g.timestamp_evento', EV) + ' / 60000000.0', 1)} AS minutos_transcurridos
FROM evento_gps g JOIN dispositivo_iot v ON v.id_dispositivo = g.id_dispositivo
JOIN paciente p ON p.id_paciente = g.id_paciente
LEFT JOIN cuidador c ON c.id_cuidador = p.id_cuidador
WHERE NOT g.dentro_zona_segura AND g.timestamp_evento >= {EV} - INTERVAL '24' HOUR"""),
    **{name: _of("evento_nfc paciente zona", f"""
, stay AS (SELECT id_paciente, id_zona, tipo_evento, timestamp_evento AS a,
                  LEAD(timestamp_evento) OVER (PARTITION BY id_paciente, id_zona
                                               ORDER BY timestamp_evento) AS b
           FROM evento_nfc {kept})
SELECT {PERSON}, z.nombre_zona, COUNT(*) AS total_visitas,
       {rounded(f"CAST(SUM({micros('a', 'b')}) AS DOUBLE) / COUNT(*) / 60000000.0", 1)}
           AS minutos_promedio_estancia,
       CAST({rounded(f"MAX({micros('a', 'b')}) / 60000000.0", 0)} AS INTEGER) AS max_estancia_min
FROM stay JOIN paciente p USING (id_paciente) JOIN zona z USING (id_zona)
WHERE b IS NOT NULL AND tipo_evento = 'Entrada'
GROUP BY p.id_paciente, paciente, z.id_zona, z.nombre_zona""")
       for name, kept in (("zone_stay", "WHERE tipo_evento = 'Entrada'"), ("zone_stay_paired", ""))},
    "silent_devices": _of("dispositivo_iot paciente", f"""
SELECT v.id_dispositivo, v.tipo_dispositivo, v.identificador_hw, v.estado,
       p.nombre || ' ' || p.apellidos AS paciente_asignado,
       strftime(v.ultima_conexion, '%d %b %Y %H:%M') AS ultima_conexion,
       {rounded(micros('v.ultima_conexion', EV) + ' / 3600000000.0', 1)} AS horas_sin_conexion,
       CASE WHEN {EV} - v.ultima_conexion > INTERVAL '24' HOUR THEN 'CRITICO'
            WHEN v.ultima_conexion IS NOT NULL THEN 'ADVERTENCIA' ELSE 'OK' END AS estado_conexion
FROM dispositivo_iot v LEFT JOIN paciente p USING (id_paciente)
WHERE v.estado = 'Activo'
  AND COALESCE({EV} - v.ultima_conexion > INTERVAL '6' HOUR, TRUE)"""),
    "feed_summary_48h": _of("paciente evento_gps evento_nfc evento_beacon", f"""
, e AS (SELECT id_paciente, 'g' AS f, NOT dentro_zona_segura AS o, timestamp_evento AS moment FROM evento_gps
        UNION ALL SELECT id_paciente, 'n', FALSE, timestamp_evento FROM evento_nfc
        UNION ALL SELECT id_paciente, 'b', FALSE, timestamp_evento FROM evento_beacon)
SELECT p.id_paciente, {PERSON}, COUNT(*) FILTER (f = 'g') AS eventos_gps,
       COUNT(*) FILTER (o) AS salidas_zona_segura, COUNT(*) FILTER (f = 'n') AS eventos_nfc,
       COUNT(*) FILTER (f = 'b') AS eventos_beacon, COUNT(f) AS total_eventos
FROM paciente p LEFT JOIN e ON e.id_paciente = p.id_paciente
 AND e.moment >= {EV} - INTERVAL '48' HOUR
GROUP BY p.id_paciente, paciente"""),
    "monthly_kpi": _of("sesion_psicologica aplicacion_escala alerta_riesgo paciente", f"""
, s AS (SELECT date_trunc('month', s.fecha_sesion) AS m, COUNT(DISTINCT s.id_sesion) AS n,
               SUM(s.duracion_min) AS minutes, COUNT(DISTINCT a.id_aplicacion) AS scales
        FROM sesion_psicologica s LEFT JOIN aplicacion_escala a ON a.id_sesion = s.id_sesion
        GROUP BY 1)
, a AS (SELECT date_trunc('month', fecha_generacion) AS m, COUNT(*) AS raised,
               COUNT(*) FILTER (estado_alerta = 'Cerrada') AS closed FROM alerta_riesgo GROUP BY 1)
, p AS (SELECT date_trunc('month', fecha_registro) AS m, COUNT(*) AS n FROM paciente GROUP BY 1)
SELECT strftime(s.m, '%Y-%m') AS mes, COALESCE(p.n, 0) AS nuevos_pacientes,
       s.n AS total_sesiones, CAST(s.minutes AS BIGINT) AS minutos_atencion,
       s.scales AS escalas_aplicadas, COALESCE(a.raised, 0) AS alertas_generadas,
       COALESCE(a.closed, 0) AS alertas_cerradas,
       {percent('COALESCE(a.closed, 0)', 'COALESCE(a.raised, 0)')} AS tasa_resolucion_pct
FROM s LEFT JOIN a ON a.m = s.m LEFT JOIN p ON p.m = s.m"""),
    "scale_distribution": _of("escala_clinica aplicacion_escala", f"""
SELECT e.id_escala, e.nombre_escala, e.tipo, COUNT(a.id_aplicacion) AS total_aplicaciones,
       {mean('a.puntaje_total', 2)} AS puntaje_promedio,
       COUNT(*) FILTER (a.nivel_riesgo = 'Normal') AS normal,
       COUNT(*) FILTER (a.nivel_riesgo = 'Leve') AS leve,
       COUNT(*) FILTER (a.nivel_riesgo = 'Moderado') AS moderado,
       COUNT(*) FILTER (a.nivel_riesgo = 'Grave') AS grave,
       {percent("COUNT(*) FILTER (a.nivel_riesgo = 'Grave')", 'COUNT(a.id_aplicacion)')} AS pct_grave
FROM escala_clinica e LEFT JOIN aplicacion_escala a USING (id_escala)
GROUP BY e.id_escala, e.nombre_escala, e.tipo"""),
    "audit_activity": _of("log_auditoria profesional rol", """
SELECT w.nombre || ' ' || w.apellidos AS usuario, rol.nombre_rol, l.operacion, l.tabla_afectada,
       COUNT(*) AS total_operaciones, MIN(strftime(l.timestamp_operacion, '%H:%M')) AS hora_min,
       MAX(strftime(l.timestamp_operacion, '%H:%M')) AS hora_max,
       COUNT(DISTINCT l.ip_origen) AS ips_distintas
FROM log_auditoria l JOIN profesional w ON w.id_profesional = l.id_usuario
JOIN rol ON rol.id_rol = w.id_rol
GROUP BY w.id_profesional, usuario, rol.nombre_rol, l.operacion, l.tabla_afectada"""),
    **{name: _of("sesion_psicologica paciente alerta_riesgo aplicacion_escala", f"""
SELECT s.n AS total_sesiones, s.minutes AS minutos_atencion, p.n AS nuevos_pacientes,
       a.n AS alertas_generadas, a.closed AS alertas_resueltas,
       {percent('a.closed', 'a.n')} AS tasa_resolucion, e.n AS escalas_aplicadas
FROM (SELECT COUNT(*) AS n, CAST(COALESCE(SUM(duracion_min), 0) AS BIGINT) AS minutes
      FROM sesion_psicologica WHERE strftime(fecha_sesion, '%Y-%m') = '{month}') s,
     (SELECT COUNT(*) AS n FROM paciente WHERE strftime(fecha_registro, '%Y-%m') = '{month}') p,
     (SELECT COUNT(*) AS n, COUNT(*) FILTER (estado_alerta = 'Cerrada') AS closed
      FROM alerta_riesgo WHERE strftime(fecha_generacion, '%Y-%m') = '{month}') a,
     (SELECT COUNT(*) AS n FROM aplicacion_escala
      WHERE strftime(fecha_aplicacion, '%Y-%m') = '{month}') e""")
       for name, month in (("monthly_report", "2000-02"), ("monthly_report_current", "2001-08"))},
    "adherence_index": _of("paciente sesion_psicologica", f"""
, h AS (SELECT p.id_paciente, COUNT(s.id_sesion) AS n
        FROM paciente p LEFT JOIN sesion_psicologica s ON s.id_paciente = p.id_paciente
         AND s.fecha_sesion >= DATE '1998-01-01' AND s.fecha_sesion <= DATE '2000-12-31'
        GROUP BY 1)
, i AS (SELECT id_paciente, n, LEAST({percent('n', '6')}, 100) AS x FROM h)
SELECT id_paciente, n AS sesiones_realizadas, CAST(x AS DOUBLE) AS indice_adherencia,
       CASE WHEN x >= 80 THEN 'Alta' WHEN x >= 50 THEN 'Media' WHEN x > 0 THEN 'Baja'
            ELSE 'Nula' END AS clasificacion FROM i"""),
    "assessment_alerts": _of("aplicacion_escala", FIRED.format(
        key="id_paciente, id_escala", fkey="f.id_paciente, f.id_escala", ts="fecha_aplicacion",
        columns="id_aplicacion, nivel_riesgo, puntaje_total", table="aplicacion_escala",
        condition="nivel_riesgo = 'Moderado' OR nivel_riesgo = 'Grave'", hours=24,
        same="r.id_paciente = f.id_paciente AND r.id_escala = f.id_escala") + """
SELECT r.id_paciente, r.id_escala, r.id_aplicacion,
       'Evaluación ' || r.id_escala || ': Riesgo ' || r.nivel_riesgo AS tipo_alerta,
       r.nivel_riesgo AS nivel_severidad,
       'Generada automáticamente. Puntaje: ' || r.puntaje_total AS descripcion,
       'Activa' AS estado_alerta, r.moment AS fecha_generacion
FROM fired JOIN risky r USING (id_paciente, id_escala, moment)
QUALIFY ROW_NUMBER() OVER (PARTITION BY r.id_paciente, r.id_escala, r.moment
                           ORDER BY r.id_aplicacion) = 1""", recursive=True),
    "zone_exit_alerts": _of("evento_gps aplicacion_escala", FIRED.format(
        key="id_paciente", fkey="f.id_paciente", ts="timestamp_evento",
        columns="latitud, longitud", table="evento_gps", condition="NOT dentro_zona_segura",
        hours=2, same="r.id_paciente = f.id_paciente") + """
SELECT r.id_paciente, x.id_aplicacion, 'Salida de Zona Segura' AS tipo_alerta,
       'Grave' AS nivel_severidad,
       'GPS detectó al paciente fuera de zona segura en ' || r.latitud || ', ' || r.longitud
           AS descripcion, 'Activa' AS estado_alerta, r.moment AS fecha_generacion
FROM fired JOIN risky r USING (id_paciente, moment)
LEFT JOIN aplicacion_escala x ON x.id_paciente = r.id_paciente AND x.fecha_aplicacion <= r.moment
QUALIFY ROW_NUMBER() OVER (PARTITION BY r.id_paciente, r.moment
                           ORDER BY x.fecha_aplicacion DESC, x.id_aplicacion DESC) = 1""",
                           recursive=True),
    "asof_assessment": _of("alerta_riesgo aplicacion_escala", """
SELECT a.id_alerta, a.id_paciente, a.fecha_generacion, x.id_aplicacion, x.puntaje_total
FROM alerta_riesgo a
LEFT JOIN aplicacion_escala x
       ON x.id_paciente = a.id_paciente AND x.fecha_aplicacion <= a.fecha_generacion
QUALIFY ROW_NUMBER() OVER (PARTITION BY a.id_alerta
                           ORDER BY x.fecha_aplicacion DESC, x.id_aplicacion DESC) = 1"""),
}

ZONE_AUDIT = f"""SELECT 0::BIGINT AS id_usuario, 'INSERT' AS operacion, 'alerta_riesgo' AS tabla_afectada,
       fecha_generacion AS timestamp_operacion, CAST(NULL AS VARCHAR) AS ip_origen
FROM ({ORACLES["zone_exit_alerts"]})"""
ORACLES["zone_exit_audit"] = ZONE_AUDIT
