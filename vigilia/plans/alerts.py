"""Alert rules (S1-S5). Each takes the rows just inserted, batch or stream, and
the reference tables; alerts carry the event's own time so that a replay gives
the same rows, or ``raised_at`` to stamp them with the time of insertion. S4 and
S5 need the keyed quiet period of `suppress`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilia.functions import clock, values as v
from vigilia.operators.sequence import asof_join
from vigilia.operators.suppress import suppress
from vigilia.plans.views import Tables, first_garden_box, open_assignments
from vigilia.sources.work import materialise

FALLBACK_STAFF = 1
ZONE_EXIT = "Salida de Zona Segura"
ALERT_LEVELS = ("Moderado", "Grave")
DAY, TWO_HOURS = 86_400, 7_200


def _stamp(event: str, raised_at) -> Column:
    return F.col(event) if raised_at is None else clock.at(raised_at)


def low_mood_incidents(checkins: DataFrame, raised_at=None) -> DataFrame:
    """A score of 2 or less raises an incident, severe for a 1."""
    return checkins.where(F.col("puntaje") <= 2).select(
        "id_residente", F.col("id_cuidador").alias("id_staff"),
        _stamp("fecha_registro", raised_at).alias("fecha"), F.lit("Agitacion").alias("tipo"),
        F.concat(F.lit("Alerta automática: puntaje de ánimo bajo ("), F.col("puntaje").cast("string"),
                 F.lit("/5) registrado por cuidador.")).alias("descripcion"),
        F.when(F.col("puntaje") == 1, "Alta").otherwise("Media").alias("severidad"))


def first_main_carer(t: Tables) -> DataFrame:
    """(id_residente, id_staff): the first open principal caregiver."""
    return open_assignments(t).where(F.col("es_principal")).groupBy("id_residente").agg(
        F.min_by("id_staff", "id_asignacion").alias("id_staff"))


def geofence_incidents(pings: DataFrame, t: Tables, raised_at=None) -> DataFrame:
    """Every ping outside the garden raises a wandering incident for the
    main caregiver, or staff 1 without one. No garden limit, no incident."""
    outside = pings.withColumn("_box", first_garden_box(t)).where(
        ~v.inside_box(F.col("latitud"), F.col("longitud"), F.col("_box")))
    return outside.join(first_main_carer(t), "id_residente", "left").select(
        "id_residente", F.coalesce("id_staff", F.lit(FALLBACK_STAFF)).alias("id_staff"),
        _stamp("registrado_en", raised_at).alias("fecha"), F.lit("Deambulacion").alias("tipo"),
        F.concat(F.lit("Alerta GPS: residente detectado fuera del perímetro del jardín. Coords: ("),
                 F.col("latitud").cast("string"), F.lit(", "), F.col("longitud").cast("string"),
                 F.lit(").")).alias("descripcion"),
        F.lit("Alta").alias("severidad"))


def restricted_access_audit(accesses: DataFrame, t: Tables) -> DataFrame:
    """S3: an access at a restricted reader writes an audit row for the staff
    member's first active user, granted or not; without a user, none."""
    restricted = t["lector_rfid"].where(F.col("es_restringido")).select("id_lector")
    users = t["usuario_sistema"].where(F.col("activo")).groupBy("id_staff").agg(
        F.min("id_usuario").alias("id_usuario"))
    return (
        accesses.join(restricted, "id_lector", "left_semi").join(users, "id_staff")
        .select("id_usuario", F.lit("acceso_rfid").alias("tabla_afectada"),
                F.lit("INSERT").alias("operacion"), F.col("id_acceso").alias("id_registro"),
                F.lit(None).cast("string").alias("ip_origen"),
                F.col("accedido_en").alias("timestamp_operacion"))
    )


def assessment_alerts(assessments: DataFrame, closed: DataFrame | None = None,
                      active: DataFrame | None = None) -> DataFrame:
    """A moderate or severe result raises an alert unless an active alert
    of the same patient and scale is at most 24 h old.

    ``closed`` (id_paciente, id_escala, fecha_aplicacion) holds closing times;
    ``active`` the last active alert per key from before these rows.
    """
    return described_assessments(suppress(
        risky_assessments(assessments), SCALE_KEYS, "fecha_aplicacion", "id_aplicacion", DAY,
        closed=closed, carry=active))


SCALE_KEYS = ["id_paciente", "id_escala"]


def risky_assessments(assessments: DataFrame) -> DataFrame:
    """S4's candidates."""
    return assessments.where(F.col("nivel_riesgo").isin(*ALERT_LEVELS))


def described_assessments(fired: DataFrame) -> DataFrame:
    """S4's alerts of the assessments that fired."""
    return fired.select(
        "id_paciente", "id_escala", "id_aplicacion",
        F.concat(F.lit("Evaluación "), F.col("id_escala"), F.lit(": Riesgo "),
                 F.col("nivel_riesgo")).alias("tipo_alerta"),
        F.col("nivel_riesgo").alias("nivel_severidad"),
        F.concat(F.lit("Generada automáticamente. Puntaje: "),
                 F.col("puntaje_total").cast("string")).alias("descripcion"),
        F.lit("Activa").alias("estado_alerta"),
        F.col("fecha_aplicacion").alias("fecha_generacion"))


def zone_exits(gps: DataFrame, closed: DataFrame | None = None,
               active: DataFrame | None = None) -> DataFrame:
    """The zone-exit events that fire: one per patient and two quiet hours."""
    out = gps.where(~F.col("dentro_zona_segura"))
    return suppress(out, ["id_paciente"], "timestamp_evento", "id_dispositivo", TWO_HOURS,
                    closed=closed, carry=active)


def zone_exit_alerts(gps: DataFrame, t: Tables, closed: DataFrame | None = None,
                     active: DataFrame | None = None) -> DataFrame:
    """Severe alert on leaving the safe zone, linked to the patient's latest
    assessment at that time, with the coordinates."""
    # Few rows, looked at more than once by the join: worked out once.
    return linked_zone_alerts(materialise(zone_exits(gps, closed, active)), t)


def linked_zone_alerts(fired: DataFrame, t: Tables) -> DataFrame:
    """S5's alerts of the zone exits that fired."""
    taken = t["aplicacion_escala"].join(fired.select("id_paciente").distinct(), "id_paciente", "left_semi")
    linked = asof_join(fired, taken, ["id_paciente"], "timestamp_evento",
                       "fecha_aplicacion", "id_aplicacion", ["id_aplicacion"])
    return linked.select(
        "id_paciente", "id_aplicacion", F.lit(ZONE_EXIT).alias("tipo_alerta"),
        F.lit("Grave").alias("nivel_severidad"),
        F.concat(F.lit("GPS detectó al paciente fuera de zona segura en "),
                 F.col("latitud").cast("string"), F.lit(", "),
                 F.col("longitud").cast("string")).alias("descripcion"),
        F.lit("Activa").alias("estado_alerta"),
        F.col("timestamp_evento").alias("fecha_generacion"))


def zone_exit_audit(alerts: DataFrame, actor: int = 0) -> DataFrame:
    """S5's third rule: each alert raised leaves an audit row."""
    return alerts.select(
        F.lit(actor).cast("bigint").alias("id_usuario"), F.lit("INSERT").alias("operacion"),
        F.lit("alerta_riesgo").alias("tabla_afectada"),
        F.col("fecha_generacion").alias("timestamp_operacion"),
        F.lit(None).cast("string").alias("ip_origen"))
