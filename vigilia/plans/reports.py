"""Care reports and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilia.functions import clock, values as v
from vigilia.operators.ranking import pivot_counts
from vigilia.plans.views import (
    CARER, Tables, accesses_on, gps_status, located_staff, named, open_assignments, ordered_by,
    pending_medication, rfid_today,
)
from vigilia.sources import layout

SEVERITIES = ("Alta", "Media", "Baja")
FEEDS = {
    "GPS": ("gps_ping", "registrado_en"),
    "NFC": ("nfc_evento", "escaneado_en"),
    "RFID": ("acceso_rfid", "accedido_en"),
    "Beacon": ("deteccion_beacon", "detectado_en"),
}
ADMIN, THERAPIST, CAREGIVER = 1, 2, 3

residents_outdoors = gps_status
access_log = rfid_today


def _active_staff(t: Tables, level: int | None = None) -> DataFrame:
    roles = t["rol"] if level is None else t["rol"].where(F.col("nivel_acceso") == level)
    return named(t, "staff", "id_staff", "_name", "id_rol", "activo").where(F.col("activo")).join(
        roles.select("id_rol", "nombre_rol"), "id_rol")


def _count_per(df: DataFrame, key: str, out: str, as_key: str = "id_staff") -> DataFrame:
    return df.groupBy(F.col(key).alias(as_key)).agg(F.count(F.lit(1)).alias(out))


def unauthorised_accesses(t: Tables, date, ordered: bool = True) -> DataFrame:
    """Granted accesses to restricted readers by staff without a shift in
    that wing that day. A reader without a wing is always reported."""
    shifts = t["turno"].where(F.col("fecha") == clock.day(date)).select(
        "id_staff", "id_ala").distinct()
    out = (
        accesses_on(t, date).where(F.col("es_restringido") & F.col("acceso_concedido"))
        .join(shifts, ["id_staff", "id_ala"], "left_anti")
    )
    out = ordered_by(out, ordered, F.desc("accedido_en"))
    return out.select("id_acceso", "staff", "especialidad", "ubicacion", "ala", "hora")


def staff_last_seen(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Like the staff location view, with the raw detection time."""
    out = ordered_by(located_staff(t, as_of), ordered, F.asc_nulls_last("ala_detectada"),
                     F.asc("apellidos"))
    return out.select("id_staff", "staff", "especialidad", "rol", "ala_detectada", "detectado_en",
                      "minutos_desde_deteccion")


def weekly_summary(t: Tables, week_start, id_staff: int | None = None,
                   ordered: bool = True) -> DataFrame:
    """A week of each active caregiver: residents, check-ins, mood, doses
    given, incidents and missed doses.

    Residents count assignments still open or ended in or after the week
    (their start is not looked at). Missed doses are active schedules nobody
    logged all week, over every caregiver assignment, ended ones included.
    """
    first = clock.day(week_start)
    carers = t["asignacion"].where(F.col("tipo_rol") == CARER).select(
        "id_staff", "id_residente", "fecha_fin")
    residents = carers.where(F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= first)).groupBy(
        "id_staff").agg(F.count_distinct("id_residente").alias("residentes_atendidos"))
    checkins = t["checkin_estado_animo"].transform(
        layout.rows_in_week, "fecha_registro", week_start
    ).groupBy(F.col("id_cuidador").alias("id_staff")).agg(
        F.count(F.lit(1)).alias("total_checkins"),
        v.mean(F.col("puntaje"), 2).alias("puntaje_animo_promedio"))
    logs = t["log_medicamento"].transform(layout.rows_in_week, "fecha_administracion", week_start)
    given = _count_per(logs, "id_cuidador", "meds_administrados")
    incidents = _count_per(
        t["reporte_incidente"].transform(layout.rows_in_week, "fecha", week_start), "id_staff",
        "incidentes_reportados")
    unlogged = (
        t["horario_medicamento"].where(F.col("activo"))
        .join(logs.select("id_horario"), "id_horario", "left_anti")
        .groupBy("id_residente").agg(F.count(F.lit(1)).alias("_missed"))
    )
    missed = carers.join(unlogged, "id_residente").groupBy("id_staff").agg(
        F.sum("_missed").alias("dosis_perdidas"))
    staff = _active_staff(t, CAREGIVER)
    if id_staff is not None:
        staff = staff.where(F.col("id_staff") == id_staff)
    out = staff
    for part in (residents, checkins, given, incidents, missed):
        out = out.join(part, "id_staff", "left")
    out = out.select(
        "id_staff", F.col("_name").alias("cuidador"), first.alias("semana_inicio"),
        F.date_add(first, 6).alias("semana_fin"),
        *[v.zero(F.col(c)).alias(c) for c in ("residentes_atendidos", "total_checkins")],
        "puntaje_animo_promedio",
        *[v.zero(F.col(c)).alias(c) for c in
          ("meds_administrados", "incidentes_reportados", "dosis_perdidas")])
    return ordered_by(out, ordered, F.asc_nulls_last("puntaje_animo_promedio"))


def _daily_mood(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.to_date("fecha_registro").alias("fecha")).agg(
        v.mean(F.col("puntaje"), 2).alias("puntaje_promedio"),
        F.count(F.lit(1)).alias("num_registros"))


def resident_mood(t: Tables, as_of, days: int = 30, id_residente: int | None = None,
                  ordered: bool = True) -> DataFrame:
    """Daily mean mood of one resident, or of each."""
    c = t["checkin_estado_animo"].transform(layout.rows_since, "fecha_registro", as_of, days=days)
    if id_residente is not None:
        c = c.where(F.col("id_residente") == id_residente)
    return ordered_by(_daily_mood(c, "id_residente"), ordered, F.asc("id_residente"),
                      F.asc("fecha"))


def global_mood(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """Daily mean mood over all residents."""
    c = t["checkin_estado_animo"].transform(layout.rows_since, "fecha_registro", as_of, days=days)
    return ordered_by(_daily_mood(c), ordered, F.asc("fecha"))


def incidents_by_severity(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """Incidents per type and severity."""
    out = (
        t["reporte_incidente"].transform(layout.rows_since, "fecha", as_of, days=days)
        .groupBy("tipo", "severidad").agg(F.count(F.lit(1)).alias("total"))
    )
    return ordered_by(out, ordered, F.asc("tipo"), F.asc("severidad"))


def incident_matrix(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """R8 as a type x severity matrix, zero where nothing happened."""
    counts = incidents_by_severity(t, as_of, days, ordered=False)
    out = pivot_counts(counts, "tipo", "severidad", SEVERITIES, F.col("total"))
    return ordered_by(out, ordered, F.asc("tipo"))


def therapy_attendance(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """Planned, attended and missed sessions per active therapist, with the
    attended percentage cut to an integer."""
    held = t["sesion_terapia"].transform(layout.rows_since, "fecha_sesion", as_of, days=days).groupBy(
        F.col("id_terapeuta").alias("id_staff")).agg(
        F.count("id_sesion").alias("_planned"), v.count_if(F.col("asistio")).alias("_held"),
        v.count_if(~F.col("asistio")).alias("_missed"))
    planned, attended = v.zero(F.col("_planned")), v.zero(F.col("_held"))
    out = _active_staff(t, THERAPIST).join(held, "id_staff", "left").select(
        "id_staff", F.col("_name").alias("terapeuta"), planned.alias("total_programadas"),
        attended.alias("realizadas"), v.zero(F.col("_missed")).alias("no_realizadas"),
        v.whole_percent(attended, planned).alias("porcentaje"))
    return ordered_by(out, ordered, F.desc("total_programadas"))


def sensor_summary(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """Events per sensor feed; a feed without events counts 0."""
    parts = [
        t[table].transform(layout.rows_since, ts, as_of, days=days).agg(
            F.lit(label).alias("tipo_evento"), F.count(F.lit(1)).alias("total"))
        for label, (table, ts) in FEEDS.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return ordered_by(out, ordered, F.asc("tipo_evento"))


def operational_load(t: Tables, as_of, days: int = 30, ordered: bool = True) -> DataFrame:
    """Sessions, check-ins and incidents per active staff member. The order
    looks at sessions and check-ins only."""
    facts = (
        ("sesion_terapia", "fecha_sesion", "id_terapeuta", "sesiones"),
        ("checkin_estado_animo", "fecha_registro", "id_cuidador", "checkins"),
        ("reporte_incidente", "fecha", "id_staff", "incidentes"),
    )
    out = _active_staff(t)
    for table, ts, key, name in facts:
        recent = t[table].transform(layout.rows_since, ts, as_of, days=days)
        out = out.join(_count_per(recent, key, name), "id_staff", "left")
    out = out.na.fill(0, [f[3] for f in facts])
    out = ordered_by(out, ordered, (F.col("sesiones") + F.col("checkins")).desc())
    return out.select(
        "id_staff", F.col("_name").alias("profesional"), F.col("nombre_rol").alias("rol"),
        "sesiones", "checkins", "incidentes",
        (F.col("sesiones") + F.col("checkins") + F.col("incidentes")).alias("total"))


def _one_row(t: Tables, **counters: DataFrame) -> DataFrame:
    """One row of scalar subqueries, each a one-row aggregate."""
    spark = next(iter(t.values())).sparkSession
    return spark.range(1).select(*[df.scalar().alias(k) for k, df in counters.items()])


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def admin_dashboard(t: Tables, as_of) -> DataFrame:
    """Active residents and staff, severe incidents of the week, doses due."""
    severe = t["reporte_incidente"].transform(layout.rows_since, "fecha", as_of, days=7).where(
        F.col("severidad") == "Alta")
    return _one_row(
        t,
        total_residentes=_count(t["residente"].where(F.col("activo"))),
        total_staff=_count(t["staff"].where(F.col("activo"))),
        incidentes_alta=_count(severe),
        meds_pendientes=_count(pending_medication(t, as_of, ordered=False)))


def _staff_keys(t: Tables, id_staff: int | None) -> DataFrame:
    staff = t["staff"].select("id_staff")
    return staff if id_staff is None else staff.where(F.col("id_staff") == id_staff)


def therapist_dashboard(t: Tables, as_of, id_staff: int | None = None) -> DataFrame:
    """Assigned residents, incidents of the week (facility-wide) and mean
    mood of the assigned residents, for every staff member."""
    mine = open_assignments(t, role=None).select("id_staff", "id_residente")
    active = t["residente"].where(F.col("activo")).select("id_residente")
    residents = mine.join(active, "id_residente", "left_semi").groupBy("id_staff").agg(
        F.count_distinct("id_residente").alias("_residents"))
    per_resident = t["checkin_estado_animo"].transform(
        layout.rows_since, "fecha_registro", as_of, days=7
    ).groupBy("id_residente").agg(
        F.sum(F.col("puntaje").cast("bigint")).alias("_sum"), F.count("puntaje").alias("_n"))
    mood = mine.join(per_resident, "id_residente").groupBy("id_staff").agg(
        v.ratio(F.sum("_sum"), F.sum("_n"), 1).alias("animo_promedio"))
    incidents = _count(t["reporte_incidente"].transform(layout.rows_since, "fecha", as_of, days=7)).scalar()
    return (
        _staff_keys(t, id_staff).join(residents, "id_staff", "left").join(mood, "id_staff", "left")
        .select("id_staff", v.zero(F.col("_residents")).alias("total_residentes"),
                incidents.alias("incidentes_activos"), "animo_promedio")
    )


def caregiver_dashboard(t: Tables, as_of, id_staff: int | None = None) -> DataFrame:
    """today's check-ins and incidents of every staff member."""
    checkins = _count_per(
        t["checkin_estado_animo"].transform(layout.rows_on_day, "fecha_registro", as_of), "id_cuidador", "_checkins")
    incidents = _count_per(
        t["reporte_incidente"].transform(layout.rows_on_day, "fecha", as_of), "id_staff", "_incidents")
    return (
        _staff_keys(t, id_staff).join(checkins, "id_staff", "left")
        .join(incidents, "id_staff", "left")
        .select("id_staff", v.zero(F.col("_checkins")).alias("checkins_hoy"),
                v.zero(F.col("_incidents")).alias("incidentes_hoy"))
    )


def sessions_by_week(t: Tables) -> DataFrame:
    """Therapy sessions and the residents in them per calendar week."""
    return t["sesion_terapia"].groupBy(clock.week_of(F.col("fecha_sesion")).alias("semana")).agg(
        F.count(F.lit(1)).alias("sesiones"), F.count_distinct("id_residente").alias("residentes"))
