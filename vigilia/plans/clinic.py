"""Clinical analytics over the ``CLINIC`` tables (Q1-Q17).

Facts are aggregated per key before they meet a dimension, so what is shuffled
for a join is one row per key and a key with a large share of the facts is
reduced map-side first. Keys are never NULL, so counting rows counts keys
without reading the key column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from vigilia.functions import clock, values as v
from vigilia.operators.ranking import latest_per_key, share_within
from vigilia.operators.sequence import shifted
from vigilia.sources import layout

Tables = Mapping[str, DataFrame]

OPEN, REVIEWED, CLOSED = "Activa", "Revisada", "Cerrada"
LEVELS = ("Normal", "Leve", "Moderado", "Grave")


def _sorted(df: DataFrame, ordered: bool, *order: Column) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def _patients(t: Tables, *extra: str) -> DataFrame:
    return t["paciente"].select(
        "id_paciente", v.full_name(F.col("nombre"), F.col("apellidos")).alias("paciente"), *extra)


def _carers(t: Tables, name: str, phone: str) -> DataFrame:
    return t["cuidador"].select(
        "id_cuidador", v.full_name(F.col("nombre"), F.col("apellidos")).alias(name),
        F.col("telefono").alias(phone))


def _current_severity(t: Tables, name: str) -> DataFrame:
    alerts = t["alerta_riesgo"].select(
        "id_paciente", "id_alerta", "fecha_generacion", F.col("nivel_severidad").alias(name))
    return latest_per_key(alerts, ["id_paciente"], "fecha_generacion", "id_alerta").select(
        "id_paciente", name)


def mood_trend(t: Tables, ordered: bool = True) -> DataFrame:
    """Q1: monthly mean mood at the start and end of sessions per patient."""
    s = t["sesion_psicologica"].where(
        F.col("estado_emoc_inicio").isNotNull() & F.col("estado_emoc_fin").isNotNull())
    monthly = s.groupBy("id_paciente", clock.month_start(F.col("fecha_sesion")).alias("_m")).agg(
        F.count(F.lit(1)).alias("total_sesiones"),
        v.mean(F.col("estado_emoc_inicio"), 2).alias("promedio_emoc_inicio"),
        v.mean(F.col("estado_emoc_fin"), 2).alias("promedio_emoc_fin"),
        v.mean(F.col("estado_emoc_fin") - F.col("estado_emoc_inicio"), 2).alias("mejora_promedio"),
    )
    out = monthly.join(_patients(t), "id_paciente").select(
        "id_paciente", "paciente", clock.month_label(F.col("_m")).alias("mes"), "total_sesiones",
        "promedio_emoc_inicio", "promedio_emoc_fin", "mejora_promedio")
    return _sorted(out, ordered, F.asc("id_paciente"), F.asc("mes"))


def score_change(t: Tables, ordered: bool = True) -> DataFrame:
    """Q2: change of every assessment score against the previous one of the
    same patient and scale; the first has none."""
    a = t["aplicacion_escala"].select(
        "id_paciente", "id_escala", "fecha_aplicacion", "id_aplicacion", "puntaje_total",
        "nivel_riesgo")
    moved = shifted(a, ["id_paciente", "id_escala"], "fecha_aplicacion", "id_aplicacion",
                    "puntaje_total", "_before", -1)
    out = (
        moved.join(t["escala_clinica"].select("id_escala", "nombre_escala"), "id_escala")
        .join(_patients(t), "id_paciente")
    )
    out = _sorted(out, ordered, F.asc("id_paciente"), F.asc("id_escala"),
                  F.asc("fecha_aplicacion"), F.asc("id_aplicacion"))
    return out.select(
        "paciente", "id_escala", "nombre_escala",
        F.date_format("fecha_aplicacion", clock.ISO_DAY).alias("fecha"), "puntaje_total",
        "nivel_riesgo", (F.col("puntaje_total") - F.col("_before")).alias("delta_puntaje"))


def unattended_severe_alerts(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Q3: patients with active severe alerts nobody took on, and for how long."""
    waiting = t["alerta_riesgo"].where(
        (F.col("nivel_severidad") == "Grave") & (F.col("estado_alerta") == OPEN)
        & F.col("id_prof_atiende").isNull())
    per_patient = waiting.groupBy("id_paciente").agg(
        F.count(F.lit(1)).alias("alertas_graves_sin_atender"),
        F.min("fecha_generacion").alias("alerta_mas_antigua"),
        F.max("fecha_generacion").alias("alerta_mas_reciente"),
    ).where(F.col("alertas_graves_sin_atender") > 0)
    out = per_patient.join(_patients(t, "diagnostico_principal"), "id_paciente").select(
        "id_paciente", "paciente", "diagnostico_principal", "alertas_graves_sin_atender",
        "alerta_mas_antigua", "alerta_mas_reciente",
        clock.hours_between(F.col("alerta_mas_antigua"), clock.at(as_of)).alias(
            "horas_sin_atencion"))
    return _sorted(out, ordered, F.desc("alertas_graves_sin_atender"),
                   F.asc("alerta_mas_antigua"))


def visit_regularity(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Q4: sessions per patient, mean days between them, days since the last."""
    per_patient = t["sesion_psicologica"].groupBy("id_paciente").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("fecha_sesion").alias("primera_sesion"),
        F.max("fecha_sesion").alias("ultima_sesion"))
    out = _patients(t, "diagnostico_principal").join(per_patient, "id_paciente", "left").select(
        "id_paciente", "paciente", "diagnostico_principal",
        v.zero(F.col("_n")).alias("total_sesiones"), "primera_sesion", "ultima_sesion",
        F.round(clock.days_between(F.col("primera_sesion"), F.col("ultima_sesion"))
                / F.nullif(F.col("_n") - 1, F.lit(0)), 1).alias("dias_promedio_entre_sesiones"),
        clock.whole_days(F.col("ultima_sesion"), clock.at(as_of)).alias("dias_sin_sesion"))
    return _sorted(out, ordered, F.desc_nulls_first("dias_sin_sesion"))


def workload(t: Tables, ordered: bool = True, dedup: bool = False) -> DataFrame:
    """Q5: sessions, patients, minutes and assessments per active professional.

    The reported minutes repeat each session once per assessment of the same
    professional (both facts hang off one join there); ``dedup`` gives the
    plain sum. Either way the facts are aggregated separately.
    """
    sessions = t["sesion_psicologica"].groupBy("id_profesional").agg(
        F.count(F.lit(1)).alias("_sessions"),
        F.count_distinct("id_paciente").alias("_patients"),
        F.sum("duracion_min").alias("_minutes"),
        v.mean(F.col("duracion_min"), 1).alias("duracion_promedio_min"))
    scales = t["aplicacion_escala"].groupBy("id_profesional").agg(
        F.count(F.lit(1)).alias("_scales"))
    copies = F.lit(1) if dedup else F.greatest(v.zero(F.col("_scales")), F.lit(1))
    staff = t["profesional"].where(F.col("activo")).join(t["rol"], "id_rol").select(
        "id_profesional", v.full_name(F.col("nombre"), F.col("apellidos")).alias("profesional"),
        "especialidad", "nombre_rol")
    out = (
        staff.join(sessions, "id_profesional", "left").join(scales, "id_profesional", "left")
        .select("id_profesional", "profesional", "especialidad", "nombre_rol",
                v.zero(F.col("_sessions")).alias("total_sesiones"),
                v.zero(F.col("_patients")).alias("pacientes_atendidos"),
                (F.col("_minutes") * copies).alias("minutos_totales"),
                "duracion_promedio_min",
                v.zero(F.col("_scales")).alias("escalas_aplicadas"))
    )
    return _sorted(out, ordered, F.desc("total_sesiones"))


def alert_resolution(t: Tables, ordered: bool = True) -> DataFrame:
    """Q6: alerts by state, resolution rate and mean hours to close per professional."""
    a = t["alerta_riesgo"]
    state = F.col("estado_alerta")
    took = F.when(state == CLOSED, clock.micros_between(
        F.col("fecha_generacion"), F.col("fecha_resolucion")))
    per_staff = a.where(F.col("id_prof_atiende").isNotNull()).groupBy(
        F.col("id_prof_atiende").alias("id_profesional")).agg(
        F.count(F.lit(1)).alias("alertas_atendidas"),
        v.sum_if(state == CLOSED).alias("cerradas"),
        v.sum_if(state == REVIEWED).alias("revisadas"),
        v.sum_if(state == OPEN).alias("aun_activas"),
        v.mean_micros(took, 3_600_000_000.0, 2).alias("horas_promedio_resolucion"))
    out = per_staff.join(t["profesional"], "id_profesional").select(
        v.full_name(F.col("nombre"), F.col("apellidos")).alias("profesional"), "especialidad",
        "alertas_atendidas", "cerradas", "revisadas", "aun_activas",
        v.percent(F.col("cerradas"), F.col("alertas_atendidas")).alias("tasa_resolucion_pct"),
        "horas_promedio_resolucion")
    return _sorted(out, ordered, F.desc_nulls_first("tasa_resolucion_pct"))


def diagnosis_severity(t: Tables, ordered: bool = True) -> DataFrame:
    """Q7: patients per diagnosis and current severity, with the share."""
    p = t["paciente"].select("id_paciente", "diagnostico_principal").join(
        _current_severity(t, "nivel_severidad"), "id_paciente", "left")
    out = share_within(p, ["diagnostico_principal"], ["nivel_severidad"], "total_pacientes",
                       "pct_dentro_diagnostico")
    return _sorted(out, ordered, F.asc_nulls_last("diagnostico_principal"),
                   F.asc_nulls_last("nivel_severidad"))


def lapsed_patients(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """Q8: patients without a session for more than ``days``, with the carer's
    contact and the current risk; patients who never had one come first."""
    last = t["sesion_psicologica"].groupBy("id_paciente").agg(
        F.max("fecha_sesion").alias("ultima_sesion"))
    lapsed = (
        _patients(t, "diagnostico_principal", "id_cuidador").join(last, "id_paciente", "left")
        .where(F.col("ultima_sesion").isNull()
               | (F.col("ultima_sesion") < clock.ago(as_of, days=days)))
    )
    out = (
        lapsed.join(_carers(t, "cuidador_responsable", "tel_cuidador"), "id_cuidador", "left")
        .join(_current_severity(t, "riesgo_actual"), "id_paciente", "left")
        .select("id_paciente", "paciente", "diagnostico_principal", "cuidador_responsable",
                "tel_cuidador", "ultima_sesion",
                clock.whole_days(F.col("ultima_sesion"), clock.at(as_of)).alias("dias_sin_sesion"),
                "riesgo_actual")
    )
    return _sorted(out, ordered, F.desc_nulls_first("dias_sin_sesion"))


def out_of_zone(t: Tables, as_of, hours: int = 24, ordered: bool = True) -> DataFrame:
    """Q9: GPS events outside the safe zone in the last hours."""
    g = t["evento_gps"].transform(layout.rows_since, "timestamp_evento", as_of, hours=hours).where(
        ~F.col("dentro_zona_segura")
    ).select("id_dispositivo", "id_paciente", "latitud", "longitud", "timestamp_evento")
    devices = t["dispositivo_iot"].select("id_dispositivo", "tipo_dispositivo", "identificador_hw")
    out = (
        g.join(devices, "id_dispositivo")
        .join(_patients(t, "diagnostico_principal", "id_cuidador"), "id_paciente")
        .join(_carers(t, "cuidador", "telefono"), "id_cuidador", "left")
    )
    out = _sorted(out, ordered, F.desc("timestamp_evento"))
    return out.select(
        "id_paciente", "paciente", "diagnostico_principal", "cuidador", "telefono",
        "tipo_dispositivo", "identificador_hw", "latitud", "longitud",
        F.date_format("timestamp_evento", clock.DAY_SECONDS_24).alias("timestamp_salida"),
        F.round(clock.minutes_between(F.col("timestamp_evento"), clock.at(as_of)), 1).alias(
            "minutos_transcurridos"))


def zone_stay(t: Tables, ordered: bool = True, paired: bool = False) -> DataFrame:
    """Q10: visits per patient and zone with mean and longest stay in minutes.

    A stay runs from one entry to the next entry of the same zone, as the
    report has always counted it. ``paired`` ends it at the next event of any
    kind in the zone instead.
    """
    e = t["evento_nfc"].select("id_paciente", "id_zona", "timestamp_evento", "tipo_evento")
    if not paired:
        e = e.where(F.col("tipo_evento") == "Entrada")
    stays = shifted(e, ["id_paciente", "id_zona"], "timestamp_evento", "tipo_evento",
                    "timestamp_evento", "_until", 1)
    stays = stays.where((F.col("tipo_evento") == "Entrada") & F.col("_until").isNotNull())
    span = clock.micros_between(F.col("timestamp_evento"), F.col("_until"))
    per_zone = stays.groupBy("id_paciente", "id_zona").agg(
        F.count(F.lit(1)).alias("total_visitas"),
        v.mean_micros(span, 60_000_000.0, 1).alias("minutos_promedio_estancia"),
        v.rounded_int(F.max(span) / F.lit(60_000_000.0)).alias("max_estancia_min"))
    out = per_zone.join(t["zona"], "id_zona").join(_patients(t), "id_paciente")
    out = _sorted(out, ordered, F.asc("id_paciente"), F.desc("total_visitas"))
    return out.select("paciente", "nombre_zona", "total_visitas", "minutos_promedio_estancia",
                      "max_estancia_min")


def silent_devices(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Q11: active devices silent for over six hours; one never seen counts as
    'OK' (its age is unknown) and is listed first."""
    seen = F.col("ultima_conexion")
    d = t["dispositivo_iot"].where(
        (F.col("estado") == "Activo")
        & ((seen < clock.ago(as_of, hours=6)) | seen.isNull()))
    out = d.join(_patients(t), "id_paciente", "left").select(
        "id_dispositivo", "tipo_dispositivo", "identificador_hw", "estado",
        F.col("paciente").alias("paciente_asignado"),
        F.date_format(seen, clock.DAY_CLOCK_24).alias("ultima_conexion"),
        F.round(clock.hours_between(seen, clock.at(as_of)), 1).alias("horas_sin_conexion"),
        F.when(seen < clock.ago(as_of, hours=24), "CRITICO")
        .when(seen < clock.ago(as_of, hours=6), "ADVERTENCIA").otherwise("OK").alias(
            "estado_conexion"))
    return _sorted(out, ordered, F.desc_nulls_first("horas_sin_conexion"))


def feed_summary(t: Tables, as_of, hours: int = 48, ordered: bool = True) -> DataFrame:
    """Q12: events per patient over the GPS, NFC and beacon feeds."""

    def recent(name: str) -> DataFrame:
        return t[name].transform(layout.rows_since, "timestamp_evento", as_of, hours=hours)

    gps = recent("evento_gps").groupBy("id_paciente").agg(
        F.count(F.lit(1)).alias("gps"), v.sum_if(~F.col("dentro_zona_segura")).alias("fuera"))
    nfc = recent("evento_nfc").groupBy("id_paciente").agg(F.count(F.lit(1)).alias("nfc"))
    beacon = recent("evento_beacon").groupBy("id_paciente").agg(F.count(F.lit(1)).alias("beacon"))
    counts = (_patients(t).join(gps, "id_paciente", "left").join(nfc, "id_paciente", "left")
              .join(beacon, "id_paciente", "left").na.fill(0, ["gps", "fuera", "nfc", "beacon"]))
    out = counts.select(
        "id_paciente", "paciente", F.col("gps").alias("eventos_gps"),
        F.col("fuera").alias("salidas_zona_segura"), F.col("nfc").alias("eventos_nfc"),
        F.col("beacon").alias("eventos_beacon"),
        (F.col("gps") + F.col("nfc") + F.col("beacon")).alias("total_eventos"))
    return _sorted(out, ordered, F.desc("total_eventos"))


def monthly_kpis(t: Tables, ordered: bool = True, dedup: bool = False) -> DataFrame:
    """Q13: sessions, minutes, assessments, alerts and new patients per month
    that had sessions. Minutes repeat a session per assessment made in it
    (``dedup`` for the plain sum)."""
    scales = t["aplicacion_escala"].where(F.col("id_sesion").isNotNull()).groupBy(
        "id_sesion").agg(F.count(F.lit(1)).alias("_scales"))
    copies = F.lit(1) if dedup else F.greatest(v.zero(F.col("_scales")), F.lit(1))
    month = clock.month_start
    sessions = (
        t["sesion_psicologica"].select("id_sesion", "fecha_sesion", "duracion_min")
        .join(scales, "id_sesion", "left")
        .groupBy(month(F.col("fecha_sesion")).alias("_m")).agg(
            F.count(F.lit(1)).alias("total_sesiones"),
            F.sum(F.col("duracion_min") * copies).alias("minutos_atencion"),
            v.zero(F.sum("_scales")).alias("escalas_aplicadas"))
    )
    alerts = t["alerta_riesgo"].groupBy(month(F.col("fecha_generacion")).alias("_m")).agg(
        F.count(F.lit(1)).alias("_raised"), v.count_if(F.col("estado_alerta") == CLOSED).alias(
            "_closed"))
    new = t["paciente"].groupBy(month(F.col("fecha_registro")).alias("_m")).agg(
        F.count(F.lit(1)).alias("_new"))
    out = sessions.join(alerts, "_m", "left").join(new, "_m", "left")
    out = _sorted(out, ordered, F.asc("_m"))
    return out.select(
        clock.month_label(F.col("_m")).alias("mes"), v.zero(F.col("_new")).alias("nuevos_pacientes"),
        "total_sesiones", "minutos_atencion", "escalas_aplicadas",
        v.zero(F.col("_raised")).alias("alertas_generadas"),
        v.zero(F.col("_closed")).alias("alertas_cerradas"),
        v.percent(v.zero(F.col("_closed")), v.zero(F.col("_raised"))).alias("tasa_resolucion_pct"))


def scale_distribution(t: Tables, ordered: bool = True) -> DataFrame:
    """Q14: use of each scale and how its results spread over the risk levels."""
    risk = F.col("nivel_riesgo")
    used = t["aplicacion_escala"].groupBy("id_escala").agg(
        F.count(F.lit(1)).alias("_n"),
        v.mean(F.col("puntaje_total"), 2).alias("puntaje_promedio"),
        *[v.count_if(risk == level).alias(level.lower()) for level in LEVELS])
    out = t["escala_clinica"].join(used, "id_escala", "left").select(
        "id_escala", "nombre_escala", "tipo", v.zero(F.col("_n")).alias("total_aplicaciones"),
        "puntaje_promedio", *[v.zero(F.col(x.lower())).alias(x.lower()) for x in LEVELS],
        v.percent(F.col("grave"), F.col("_n")).alias("pct_grave"))
    return _sorted(out, ordered, F.desc("total_aplicaciones"))


def audit_activity(t: Tables, ordered: bool = True) -> DataFrame:
    """Q15: audit operations per user, operation and table: hours and IPs."""
    # Minutes of the day order like their text and aggregate without sorting.
    minute = F.hour("timestamp_operacion") * 60 + F.minute("timestamp_operacion")
    used = t["log_auditoria"].groupBy("id_usuario", "operacion", "tabla_afectada").agg(
        F.count(F.lit(1)).alias("total_operaciones"),
        F.min(minute).alias("_first"), F.max(minute).alias("_last"),
        F.count_distinct("ip_origen").alias("ips_distintas"),
    ).where(F.col("total_operaciones") > 0)
    staff = t["profesional"].join(t["rol"], "id_rol").select(
        F.col("id_profesional").alias("id_usuario"),
        v.full_name(F.col("nombre"), F.col("apellidos")).alias("usuario"), "nombre_rol")
    out = used.join(staff, "id_usuario").select(
        "usuario", "nombre_rol", "operacion", "tabla_afectada", "total_operaciones",
        clock.minute_label(F.col("_first")).alias("hora_min"),
        clock.minute_label(F.col("_last")).alias("hora_max"), "ips_distintas")
    return _sorted(out, ordered, F.desc("total_operaciones"), F.asc("operacion"))


def monthly_report(t: Tables, as_of, year: int = 0, month: int = 0) -> DataFrame:
    """Q16: one row of KPIs for a month; 0 means the current year or month."""
    first = F.make_date(
        F.lit(year) if year else F.year(clock.day(as_of)),
        F.lit(month) if month else F.month(clock.day(as_of)), F.lit(1))
    start = first.cast("timestamp_ntz")
    end = F.add_months(first, 1).cast("timestamp_ntz")

    def within(name: str, ts: str) -> DataFrame:
        return t[name].where((F.col(ts) >= start) & (F.col(ts) < end))

    n = F.count(F.lit(1))
    sessions = within("sesion_psicologica", "fecha_sesion")
    alerts = within("alerta_riesgo", "fecha_generacion").agg(F.struct(
        n.alias("raised"), v.count_if(F.col("estado_alerta") == CLOSED).alias("closed")).alias("x"))
    session_sums = sessions.agg(F.struct(
        n.alias("n"), v.zero(F.sum("duracion_min")).alias("minutes")).alias("x"))
    one = t["paciente"].sparkSession.range(1).select(
        session_sums.scalar().alias("_s"), alerts.scalar().alias("_a"),
        within("paciente", "fecha_registro").agg(n.alias("n")).scalar().alias("_new"),
        within("aplicacion_escala", "fecha_aplicacion").agg(n.alias("n")).scalar().alias("_scales"))
    return one.select(
        F.col("_s.n").alias("total_sesiones"), F.col("_s.minutes").alias("minutos_atencion"),
        F.col("_new").alias("nuevos_pacientes"), F.col("_a.raised").alias("alertas_generadas"),
        F.col("_a.closed").alias("alertas_resueltas"),
        v.percent(F.col("_a.closed"), F.col("_a.raised")).alias("tasa_resolucion"),
        F.col("_scales").alias("escalas_aplicadas"))


def adherence_index(t: Tables, first_day, last_day, expected: int | Column,
                    ordered: bool = True) -> DataFrame:
    """Q17: sessions held against sessions expected per patient and its class.

    The period ends at midnight opening ``last_day``; nothing expected gives
    100. ``expected`` may be an expression over the patient columns.
    """
    held = t["sesion_psicologica"].where(
        F.col("fecha_sesion").between(clock.at(first_day), clock.at(last_day))
    ).groupBy("id_paciente").agg(F.count(F.lit(1)).alias("_held"))
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    p = t["paciente"].withColumn("_expected", wanted).select("id_paciente", "_expected")
    done = v.zero(F.col("_held"))
    index = F.least(v.percent(done, F.col("_expected")), F.lit(100.0))
    out = p.join(held, "id_paciente", "left").select(
        "id_paciente", done.alias("sesiones_realizadas"), index.alias("indice_adherencia"),
        v.adherence_class(index).alias("clasificacion"))
    return _sorted(out, ordered, F.asc("id_paciente"))
