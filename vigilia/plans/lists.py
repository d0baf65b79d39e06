"""Detail lists per resident and per staff member.

A list computes all keys at once and carries the key column; passing an id
narrows it. Where one key's list is cut to its last rows, the cut is per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilia.functions import clock, values as v
from vigilia.operators.ranking import latest_per_key, top_k_per_key
from vigilia.plans.views import (
    CARER, Tables, named, open_assignments, ordered_by, pending_medication, residents_summary,
)
from vigilia.sources import layout


def _only(df: DataFrame, **ids) -> DataFrame:
    for column, wanted in ids.items():
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def _last(df: DataFrame, key: str, ts: str, tie: str, k: int, ordered: bool,
          **parents: DataFrame) -> DataFrame:
    """The newest ``k`` rows per key that have all ``parents`` (a table of unique
    keys for each column), whose columns are joined to the rows kept only."""
    newest = [F.col(ts).desc(), F.col(tie).desc()]
    for column, parent in parents.items():
        df = df.join(parent.select(column), column, "left_semi")
    kept = top_k_per_key(df, [key], newest, k)
    for column, parent in parents.items():
        kept = kept.join(parent, column)
    return ordered_by(kept, ordered, F.asc(key), *newest)


def _rooms(t: Tables) -> DataFrame:
    return t["sala"].select("id_sala", F.col("nombre").alias("sala"))


def _residents(t: Tables, *extra: str) -> DataFrame:
    return named(t, "residente", "id_residente", "residente", *extra)


def resident_detail(t: Tables, as_of, id_residente: int | None = None) -> DataFrame:
    """A resident's record with age; the admission date becomes text."""
    r = _only(t["residente"], id_residente=id_residente)
    return r.withColumns({
        "edad": clock.age_years(F.col("fecha_nacimiento"), as_of),
        "fecha_ingreso": F.date_format("fecha_ingreso", clock.DAY_LABEL)})


def resident_assignments(t: Tables, id_residente: int | None = None,
                         ordered: bool = True) -> DataFrame:
    """Open assignments; the role shown is the staff member's own."""
    a = _only(open_assignments(t, role=None), id_residente=id_residente)
    staff = named(t, "staff", "id_staff", "staff_nombre", "id_rol").join(
        t["rol"].select("id_rol", F.col("nombre_rol").alias("tipo_rol")), "id_rol").drop("id_rol")
    out = a.drop("tipo_rol").join(staff, "id_staff")
    return ordered_by(out, ordered, F.desc("es_principal"))


def resident_sessions(t: Tables, id_residente: int | None = None, k: int = 10,
                      ordered: bool = True) -> DataFrame:
    """Last ten therapy sessions per resident."""
    return _last(_only(t["sesion_terapia"], id_residente=id_residente),
                 "id_residente", "fecha_sesion", "id_sesion", k, ordered,
                 id_terapeuta=named(t, "staff", "id_staff", "terapeuta", as_key="id_terapeuta"),
                 id_sala=_rooms(t))


def resident_checkins(t: Tables, id_residente: int | None = None, k: int = 10,
                      ordered: bool = True) -> DataFrame:
    """Last ten mood check-ins per resident."""
    return _last(_only(t["checkin_estado_animo"], id_residente=id_residente),
                 "id_residente", "fecha_registro", "id_checkin", k, ordered,
                 id_cuidador=named(t, "staff", "id_staff", "cuidador", as_key="id_cuidador"))


def _reported(t: Tables, id_residente: int | None = None) -> DataFrame:
    return _only(t["reporte_incidente"], id_residente=id_residente).join(
        named(t, "staff", "id_staff", "reportado_por"), "id_staff")


def resident_recent_incidents(t: Tables, id_residente: int | None = None, k: int = 5,
                              ordered: bool = True) -> DataFrame:
    """Last five incidents per resident, date as text."""
    out = _last(_only(t["reporte_incidente"], id_residente=id_residente),
                "id_residente", "fecha", "id_incidente", k, ordered,
                id_staff=named(t, "staff", "id_staff", "reportado_por"))
    return out.withColumn("fecha", F.date_format("fecha", clock.DAY_CLOCK))


def audit_log(t: Tables, k: int = 200) -> DataFrame:
    """The newest audit rows with user and person."""
    users = t["usuario_sistema"].select("id_usuario", "username", "id_staff").join(
        named(t, "staff", "id_staff", "usuario_nombre"), "id_staff").drop("id_staff")
    newest = [F.desc("timestamp_operacion"), F.desc("id_log")]
    return (
        t["log_auditoria"].join(users.select("id_usuario"), "id_usuario", "left_semi")
        .orderBy(*newest).limit(k).join(users, "id_usuario").orderBy(*newest)
        .withColumn("fecha_hora", F.date_format("timestamp_operacion", clock.DAY_CLOCK))
    )


def therapist_sessions_today(t: Tables, as_of, id_staff: int | None = None,
                             ordered: bool = True) -> DataFrame:
    """today's sessions of a therapist."""
    out = (
        _only(t["sesion_terapia"], id_terapeuta=id_staff)
        .transform(layout.rows_on_day, "fecha_sesion", as_of)
        .join(_residents(t), "id_residente").join(_rooms(t), "id_sala")
        .withColumn("hora_inicio", F.date_format("fecha_sesion", clock.CLOCK))
    )
    return ordered_by(out, ordered, F.asc("fecha_sesion"))


def therapist_residents(t: Tables, as_of, id_staff: int | None = None) -> DataFrame:
    """Summaries of the residents assigned to a therapist and how many
    sessions the two had."""
    pairs = _only(open_assignments(t, role=None), id_staff=id_staff).select(
        "id_staff", "id_residente").distinct()
    sessions = t["sesion_terapia"].groupBy(
        F.col("id_terapeuta").alias("id_staff"), "id_residente").agg(
        F.count(F.lit(1)).alias("_n"))
    return (
        pairs.join(residents_summary(t, as_of, ordered=False), "id_residente")
        .join(sessions, ["id_staff", "id_residente"], "left")
        .withColumn("total_sesiones", v.zero(F.col("_n"))).drop("_n")
    )


def therapist_sessions(t: Tables, id_staff: int | None = None, ordered: bool = True) -> DataFrame:
    """All sessions of a therapist."""
    out = (
        _only(t["sesion_terapia"], id_terapeuta=id_staff)
        .join(_residents(t), "id_residente").join(_rooms(t), "id_sala")
        .withColumn("fecha_sesion_fmt", F.date_format("fecha_sesion", clock.DAY_CLOCK))
    )
    return ordered_by(out, ordered, F.desc("fecha_sesion"))


def pair_sessions(t: Tables, id_residente: int | None = None, id_staff: int | None = None,
                  ordered: bool = True) -> DataFrame:
    """Sessions between a resident and a therapist."""
    out = _only(t["sesion_terapia"], id_residente=id_residente, id_terapeuta=id_staff).join(
        _rooms(t), "id_sala")
    return ordered_by(out, ordered, F.desc("fecha_sesion"))


def _assigned(t: Tables, role: str | None, id_staff: int | None, *columns: str) -> DataFrame:
    """Open assignments of active residents: a row per assignment."""
    active = t["residente"].where(F.col("activo")).select("id_residente", *columns)
    return _only(open_assignments(t, role), id_staff=id_staff).select(
        "id_staff", "id_residente").join(active, "id_residente")


def residents_for_session(t: Tables, id_staff: int | None = None,
                          ordered: bool = True) -> DataFrame:
    """Residents a therapist may book."""
    out = _assigned(t, None, id_staff, "nombre", "apellidos", "habitacion")
    return ordered_by(out, ordered, F.asc("apellidos"))


def resident_incidents(t: Tables, id_residente: int | None = None,
                       ordered: bool = True) -> DataFrame:
    """All incidents of a resident, date as text."""
    out = ordered_by(_reported(t, id_residente), ordered, F.desc("fecha"))
    return out.withColumn("fecha", F.date_format("fecha", clock.DAY_LABEL))


def all_incidents(t: Tables, ordered: bool = True) -> DataFrame:
    """Every incident with resident and reporter."""
    out = ordered_by(_reported(t).join(_residents(t), "id_residente"), ordered, F.desc("fecha"))
    return out.withColumn("fecha", F.date_format("fecha", clock.DAY_CLOCK))


def caregiver_resident_ids(t: Tables, id_staff: int | None = None) -> DataFrame:
    """Ids of the residents of a caregiver."""
    return _assigned(t, CARER, id_staff)


def caregiver_pending_medication(t: Tables, as_of, id_staff: int | None = None) -> DataFrame:
    """today's pending doses of a caregiver's residents."""
    mine = _only(open_assignments(t), id_staff=id_staff).select("id_staff", "id_residente")
    return pending_medication(t, as_of, ordered=False).join(mine, "id_residente")


def caregiver_latest_mood(t: Tables, id_staff: int | None = None,
                          at_most: int | None = None) -> DataFrame:
    """Latest mood of each resident of a caregiver. ``at_most`` filters
    after the latest row is known: an older low score does not count."""
    latest = latest_per_key(
        t["checkin_estado_animo"].select("id_residente", "id_checkin", "fecha_registro", "puntaje"),
        ["id_residente"], "fecha_registro", "id_checkin")
    mine = _only(open_assignments(t), id_staff=id_staff).select(
        "id_staff", "id_residente").distinct()
    out = mine.join(latest, "id_residente").join(_residents(t), "id_residente").select(
        "id_staff", "id_residente", "residente", "puntaje")
    return out if at_most is None else out.where(F.col("puntaje") <= at_most)


def caregiver_residents(t: Tables, as_of, id_staff: int | None = None) -> DataFrame:
    """Summaries of a caregiver's residents."""
    pairs = _only(open_assignments(t), id_staff=id_staff).select(
        "id_staff", "id_residente").distinct()
    return pairs.join(residents_summary(t, as_of, ordered=False), "id_residente")


def caregiver_resident_names(t: Tables, id_staff: int | None = None,
                             ordered: bool = True) -> DataFrame:
    """Names and rooms of a caregiver's residents."""
    out = _assigned(t, CARER, id_staff, "nombre", "apellidos", "habitacion")
    return ordered_by(out, ordered, F.asc("apellidos"))


def medication_given_today(t: Tables, as_of, id_staff: int | None = None,
                           ordered: bool = True) -> DataFrame:
    """today's doses and how they were confirmed. The dose comes from the
    schedule; a log with several scans gives a row per scan."""
    schedules = t["horario_medicamento"].select(
        "id_horario", "id_medicamento", "id_residente", "dosis")
    scans = t["nfc_evento"].where(F.col("id_log_med").isNotNull()).select(
        F.col("id_log_med").alias("id_log"), F.lit("NFC").alias("_how"))
    out = (
        _only(t["log_medicamento"], id_cuidador=id_staff)
        .transform(layout.rows_on_day, "fecha_administracion", as_of)
        .join(schedules, "id_horario")
        .join(t["medicamento"].select("id_medicamento", F.col("nombre").alias("medicamento")),
              "id_medicamento")
        .join(_residents(t, "habitacion"), "id_residente")
        .join(named(t, "staff", "id_staff", "confirmado_por", as_key="id_cuidador"), "id_cuidador")
        .join(scans, "id_log", "left")
    )
    out = ordered_by(out, ordered, F.desc("fecha_administracion"))
    return out.select(
        "id_log", "id_horario", "id_cuidador", "fecha_administracion", "incidente", "medicamento",
        "dosis", "residente", "habitacion", "confirmado_por",
        F.date_format("fecha_administracion", clock.CLOCK).alias("hora_administrado"),
        F.coalesce("_how", F.lit("Manual")).alias("metodo"))


def nfc_tags(t: Tables, ordered: bool = True) -> DataFrame:
    """Each tag with its resident and first scheduled medicine, or the
    tag's own description when there is none."""
    first = t["horario_medicamento"].groupBy("id_residente").agg(
        F.min_by("id_medicamento", "id_horario").alias("id_medicamento"))
    out = (
        t["nfc_tag"].join(_residents(t, "habitacion"), "id_residente")
        .join(first, "id_residente", "left")
        .join(t["medicamento"].select("id_medicamento", F.col("nombre").alias("_medicine")),
              "id_medicamento", "left")
        .select("id_tag", "codigo_tag", "descripcion", "residente", "habitacion",
                F.coalesce("_medicine", "descripcion").alias("medicamento"))
    )
    return ordered_by(out, ordered, F.asc("id_tag"))


def nfc_scans_today(t: Tables, as_of, id_staff: int | None = None, k: int = 10,
                    ordered: bool = True) -> DataFrame:
    """Last ten scans of today per staff member."""
    scans = _only(t["nfc_evento"], id_staff=id_staff).transform(layout.rows_on_day, "escaneado_en", as_of)
    tags = t["nfc_tag"].select(
        "id_tag", "id_residente", F.col("descripcion").alias("medicamento")).join(
        _residents(t), "id_residente")
    return _last(scans, "id_staff", "escaneado_en", "id_evento", k, ordered, id_tag=tags).select(
        "id_staff", "id_evento", F.date_format("escaneado_en", clock.CLOCK).alias("hora"),
        "medicamento", "residente")
