"""The care views (VW1-VW8) as functions of ``as_of``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from vigilia.functions import clock, values as v
from vigilia.operators.ranking import latest_per_key
from vigilia.sources import layout

Tables = Mapping[str, DataFrame]

CARER = "Cuidador"


def ordered_by(df: DataFrame, ordered: bool, *order: Column) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def named(t: Tables, table: str, key: str, out: str, *extra: str, as_key: str | None = None):
    """(key, full name, extra columns) of a person table."""
    return t[table].select(
        F.col(key).alias(as_key or key),
        v.full_name(F.col("nombre"), F.col("apellidos")).alias(out), *extra)


def open_assignments(t: Tables, role: str | None = CARER) -> DataFrame:
    a = t["asignacion"].where(F.col("fecha_fin").isNull())
    return a.where(F.col("tipo_rol") == role) if role else a


def main_carer(t: Tables, out: str) -> DataFrame:
    """Open principal caregiver per resident: (id_residente, out). A resident
    with two such assignments gets two rows."""
    principal = open_assignments(t).where(F.col("es_principal")).select("id_residente", "id_staff")
    return principal.join(named(t, "staff", "id_staff", out), "id_staff", "left").select(
        "id_residente", out)


def latest_mood(t: Tables) -> DataFrame:
    c = t["checkin_estado_animo"].select("id_residente", "id_checkin", "fecha_registro", "puntaje")
    return latest_per_key(c, ["id_residente"], "fecha_registro", "id_checkin")


def residents_summary(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW1: active residents with main caregiver, latest mood and age."""
    mood = latest_mood(t).select(
        "id_residente", F.col("puntaje").alias("ultimo_puntaje_animo"),
        F.date_format("fecha_registro", clock.SHORT_DAY_CLOCK).alias("fecha_ultimo_checkin"))
    out = (
        t["residente"].where(F.col("activo"))
        .join(main_carer(t, "cuidador_principal"), "id_residente", "left")
        .join(mood, "id_residente", "left")
    )
    out = ordered_by(out, ordered, F.asc("apellidos"))
    return out.select(
        "id_residente", v.full_name(F.col("nombre"), F.col("apellidos")).alias("residente"),
        "habitacion", "diagnostico_principal", "nivel_movilidad",
        clock.age_years(F.col("fecha_nacimiento"), as_of).alias("edad"), "cuidador_principal",
        "ultimo_puntaje_animo", "fecha_ultimo_checkin", "fecha_ingreso")


def pending_medication(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW2: active schedules of active residents without a dose logged today.
    The schedule's frequency is not looked at."""
    given = t["log_medicamento"].transform(layout.rows_on_day, "fecha_administracion", as_of).select("id_horario")
    due = t["horario_medicamento"].where(F.col("activo")).join(given, "id_horario", "left_anti")
    out = (
        due.join(named(t, "residente", "id_residente", "residente", "habitacion", "activo")
                 .where(F.col("activo")).drop("activo"), "id_residente")
        .join(t["medicamento"].select("id_medicamento", F.col("nombre").alias("medicamento")),
              "id_medicamento")
        .join(main_carer(t, "cuidador_asignado"), "id_residente", "left")
        .select("id_horario", "id_residente", "residente", "habitacion", "medicamento", "dosis",
                "hora_programada", "cuidador_asignado")
    )
    return ordered_by(out, ordered, F.asc("hora_programada"))


def sessions_today(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW3: today's therapy sessions with resident, therapist and room."""
    out = (
        t["sesion_terapia"].transform(layout.rows_on_day, "fecha_sesion", as_of)
        .join(named(t, "residente", "id_residente", "residente", "habitacion"), "id_residente")
        .join(named(t, "staff", "id_staff", "terapeuta", as_key="id_terapeuta"), "id_terapeuta")
        .join(t["sala"].select("id_sala", F.col("nombre").alias("sala")), "id_sala")
    )
    out = ordered_by(out, ordered, F.asc("fecha_sesion"))
    return out.select("id_sesion", "residente", "habitacion", "terapeuta", "sala", "tipo_sesion",
                      "duracion_min", F.date_format("fecha_sesion", clock.CLOCK).alias("hora"),
                      "asistio")


def staff_on_shift(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW4: active staff on shift today with their wing."""
    staff = named(t, "staff", "id_staff", "staff", "especialidad", "id_rol", "activo").where(
        F.col("activo"))
    out = (
        t["turno"].where(F.col("fecha") == clock.day(as_of))
        .select("id_staff", "id_ala", "hora_inicio", "hora_fin")
        .join(staff, "id_staff")
        .join(t["ala"].select("id_ala", F.col("nombre").alias("ala")), "id_ala")
        .join(t["rol"].select("id_rol", F.col("nombre_rol").alias("rol")), "id_rol")
        .select("id_staff", "staff", "especialidad", "rol", "ala", "hora_inicio", "hora_fin")
    )
    return ordered_by(out, ordered, F.asc("ala"), F.asc("hora_inicio"))


def accesses_on(t: Tables, date) -> DataFrame:
    """Accesses of one day with staff, reader and wing (wing may be unknown)."""
    return (
        t["acceso_rfid"].transform(layout.rows_on_day, "accedido_en", date)
        .join(named(t, "staff", "id_staff", "staff", "especialidad"), "id_staff")
        .join(t["lector_rfid"].select("id_lector", "ubicacion", "es_restringido", "id_ala"),
              "id_lector")
        .join(t["ala"].select("id_ala", F.col("nombre").alias("ala")), "id_ala", "left")
        .withColumn("hora", F.date_format("accedido_en", clock.CLOCK))
    )


def rfid_today(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW5 and R2: access log of a day."""
    out = ordered_by(accesses_on(t, as_of), ordered, F.desc("accedido_en"))
    return out.select("id_acceso", "staff", "especialidad", "ubicacion", "ala", "es_restringido",
                      "acceso_concedido", "hora")


def recent_incidents(t: Tables, as_of, days: int = 7, ordered: bool = True) -> DataFrame:
    """VW6: incidents of the last days, most severe first."""
    out = (
        t["reporte_incidente"].transform(layout.rows_since, "fecha", as_of, days=days)
        .join(named(t, "residente", "id_residente", "residente", "habitacion"), "id_residente")
        .join(named(t, "staff", "id_staff", "reportado_por"), "id_staff")
    )
    out = ordered_by(out, ordered, v.severity_rank(F.col("severidad")).asc(), F.desc("fecha"))
    return out.select("id_incidente", "residente", "habitacion", "reportado_por", "tipo",
                      "severidad", "descripcion",
                      F.date_format("fecha", clock.SHORT_DAY_CLOCK).alias("fecha"))


def located_staff(t: Tables, as_of) -> DataFrame:
    """Active staff on shift today (a row per shift) with the latest beacon
    detection; staff never detected stay with NULLs."""
    beacons = t["beacon"].select("id_beacon", "id_ala")
    seen = t["deteccion_beacon"].select("id_staff", "id_deteccion", "detectado_en", "id_beacon").join(
        beacons, "id_beacon", "left_semi")
    seen = latest_per_key(seen, ["id_staff"], "detectado_en", "id_deteccion").join(
        beacons, "id_beacon").drop("id_beacon")
    wings = t["ala"].select("id_ala", F.col("nombre").alias("ala_detectada"))
    people = t["staff"].where(F.col("activo")).join(
        t["rol"].select("id_rol", F.col("nombre_rol").alias("rol")), "id_rol")
    shifts = t["turno"].where(F.col("fecha") == clock.day(as_of)).select("id_staff")
    return (
        shifts.join(people, "id_staff").join(seen, "id_staff", "left")
        .join(wings, "id_ala", "left")
        .withColumn("staff", v.full_name(F.col("nombre"), F.col("apellidos")))
        .withColumn("minutos_desde_deteccion",
                    clock.minutes_between(F.col("detectado_en"), clock.at(as_of)))
    )


def staff_location(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW7: where each staff member on shift was last detected."""
    out = ordered_by(located_staff(t, as_of), ordered, F.asc_nulls_last("ala_detectada"),
                     F.asc("apellidos"))
    return out.select("id_staff", "staff", "especialidad", "rol", "ala_detectada",
                      F.date_format("detectado_en", clock.CLOCK).alias("ultima_deteccion"),
                      "minutos_desde_deteccion")


def first_garden_box(t: Tables) -> Column:
    """The limit of the lowest id, as a scalar that is NULL without any limit."""
    return t["limite_jardin"].agg(F.min_by(
        F.struct("lat_min", "lat_max", "lon_min", "lon_max"), "id_limite").alias("box")).scalar()


def gps_status(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """VW8 and R1: latest ping of each active resident, inside the garden or
    not. Residents without a ping are absent; without a limit, all are."""
    pings = latest_per_key(
        t["gps_ping"].select("id_residente", "id_ping", "latitud", "longitud", "registrado_en"),
        ["id_residente"], "registrado_en", "id_ping")
    people = named(t, "residente", "id_residente", "residente", "habitacion", "activo").where(
        F.col("activo"))
    out = (
        people.join(pings, "id_residente")
        .withColumn("_box", first_garden_box(t)).where(F.col("_box").isNotNull())
        .select("id_residente", "residente", "habitacion", "latitud", "longitud", "registrado_en",
                v.inside_box(F.col("latitud"), F.col("longitud"), F.col("_box")).alias(
                    "dentro_limite"),
                clock.minutes_between(F.col("registrado_en"), clock.at(as_of)).alias(
                    "minutos_desde_ping"))
    )
    return ordered_by(out, ordered, F.asc("dentro_limite"), F.asc("minutos_desde_ping"))
