"""Table changes (C1-C10): batches of requests with the outcome of each.

A request row carries ``change_id`` (unique; the order requests were made in)
and, where the change is audited, ``actor_id``. Requests for a table come
together as one DataFrame; the result holds the new snapshots, one
``(change_id, ok, msg)`` row per request and the audit rows. Nothing is
modified in place: the caller writes the snapshots.

Identity columns of new rows are not requested; defaults of the tables
(``activo``, dates) are filled from ``as_of``.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigilia.functions import clock
from vigilia.operators import checks, overlap
from vigilia.operators.numbering import dense_ids, highest
from vigilia.operators.ranking import latest_per_key
from vigilia.operators.rounds import BLOCK, accept_in_order
from vigilia.operators.sequence import nearest_daily
from vigilia.plans.views import Tables
from vigilia.sources.work import materialise

ERROR = "Error: "
LONGEST_SESSION = 480


@dataclass
class Result:
    """``tables`` and ``created`` may be worked out when first looked into."""

    tables: Mapping[str, DataFrame]
    outcome: DataFrame
    audit: DataFrame | None = None
    created: Mapping[str, DataFrame] = field(default_factory=dict)


class _Later(Mapping):
    """Tables made on first use: numbering new rows runs a job, which a caller
    who asks for the outcome only does not need."""

    def __init__(self, make: Callable[[], dict[str, DataFrame]]):
        self._make, self._made = make, None

    def _all(self) -> dict[str, DataFrame]:
        if self._made is None:
            self._made = self._make()
        return self._made

    def __getitem__(self, name: str) -> DataFrame:
        return self._all()[name]

    def __iter__(self):
        return iter(self._all())

    def __len__(self) -> int:
        return len(self._all())


def _appended(t: Tables, created: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
    """The snapshots: stored tables with their new rows."""
    return _Later(lambda: {name: t[name].unionByName(rows) for name, rows in created.items()})


def _outcome(df: DataFrame, failure: Column, success: Column) -> DataFrame:
    """``failure`` is NULL for an accepted request."""
    return df.select("change_id", F.when(failure.isNull(), 1).otherwise(0).alias("ok"),
                     F.coalesce(failure, success).alias("msg"))


def _reference_failure(df: DataFrame, t: Tables, table: str, columns=None) -> DataFrame:
    """Adds ``_missing``: the foreign keys of a request without a parent."""
    flags = []
    for column, (parent, parent_key) in checks.REFERENCES.get(table, {}).items():
        if column not in df.columns or (columns is not None and column not in columns):
            continue
        flag = f"_known_{column}"
        parents = t[parent].select(F.col(parent_key).alias(column), F.lit(True).alias(flag))
        df = df.join(parents, column, "left")
        flags.append(F.when(F.col(column).isNotNull() & F.col(flag).isNull(),
                            F.lit(f"{column}_referencia")))
    found = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return df.withColumn("_missing", found).drop(
        *[c for c in df.columns if c.startswith("_known_")])


def _checked(df: DataFrame, t: Tables, table: str, as_of, columns) -> DataFrame:
    """Adds ``_error``: what makes the database refuse the row, or NULL."""
    rules = {n: c for n, c in checks.row_rules(table, as_of, columns).items()
             if n in _rules_over(table, columns)}
    df = _reference_failure(df, t, table, columns)
    broken = F.concat(checks.broken_rules(rules), F.col("_missing"))
    return df.withColumn(
        "_error", F.when(F.size(broken) > 0, F.concat(F.lit(ERROR), F.array_join(broken, ", ")))
    ).drop("_missing")


def _rules_over(table: str, columns) -> set[str]:
    """Row rules whose every column is among ``columns``."""
    known = set(columns)
    names = {f"{c}_requerido" for c in known} | {f"{c}_largo" for c in known}
    all_columns = set(checks.REQUIRED[table].split()) | set(checks.LENGTHS.get(table, {})) | {
        "fecha_fin"}
    for name, text in checks.ROW_RULES.get(table, {}).items():
        words = set(text.replace("(", " ").replace(",", " ").split())
        if words & all_columns <= known:
            names.add(name)
    return names


def _audit(changed: DataFrame, table: str, key: str, operation: str, as_of) -> DataFrame:
    """An audit row per applied change."""
    return changed.select(
        F.col("actor_id").cast("bigint").alias("id_usuario"), F.lit(table).alias("tabla_afectada"),
        F.lit(operation).alias("operacion"), F.col(key).alias("id_registro"),
        F.lit(None).cast("string").alias("ip_origen"), clock.at(as_of).alias("timestamp_operacion"))


def _actor_error(df: DataFrame, t: Tables) -> DataFrame:
    """The audit row of an unknown actor (0 when unset) breaks its reference
    to the users, which undoes the change it belongs to."""
    users = t["usuario_sistema"].select(F.col("id_usuario").alias("_actor"))
    actors = df.withColumn("_actor", F.coalesce(F.col("actor_id"), F.lit(0)).cast("bigint"))
    known = users.withColumn("_known", F.lit(True))
    return actors.join(known, "_actor", "left").withColumn(
        "_actor_error", F.when(F.col("_known").isNull(), F.lit(ERROR + "id_usuario_referencia"))
    ).drop("_actor", "_known")


# --- C1: validated appends -------------------------------------------------


def append(t: Tables, table: str, key: str, requests: DataFrame, as_of, success: str,
           defaults: dict[str, Column] | None = None) -> Result:
    """Append the rows that satisfy the table's constraints; the rest only get
    an outcome. New keys follow the stored ones in ``change_id`` order."""
    rows = requests
    for column, value in (defaults or {}).items():
        rows = rows.withColumn(
            column, F.coalesce(F.col(column), value) if column in rows.columns else value)
    columns = [c for c in t[table].columns if c != key]
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t[table].schema[c].dataType))
    rows = _checked(rows, t, table, as_of, columns)
    created = _Later(lambda: {table: dense_ids(
        rows.where(F.col("_error").isNull()), "change_id", key, highest(t[table], key)).select(*t[table].columns)})
    return Result(_appended(t, created), _outcome(rows, F.col("_error"), F.lit(success)), created=created)


def add_checkins(t: Tables, requests: DataFrame, as_of) -> Result:
    return append(t, "checkin_estado_animo", "id_checkin", requests, as_of, "Check-in registrado.",
                  {"fecha_registro": clock.at(as_of)})


def add_incidents(t: Tables, requests: DataFrame, as_of) -> Result:
    return append(t, "reporte_incidente", "id_incidente", requests, as_of, "Incidente registrado.",
                  {"fecha": clock.at(as_of)})


def add_accesses(t: Tables, requests: DataFrame, as_of) -> Result:
    """An access without a verdict counts as granted."""
    return append(t, "acceso_rfid", "id_acceso", requests, as_of, "Acceso registrado.",
                  {"accedido_en": clock.at(as_of), "acceso_concedido": F.lit(True)})


def add_audit(t: Tables, requests: DataFrame, as_of) -> Result:
    return append(t, "log_auditoria", "id_log", requests, as_of, "Auditoría registrada.",
                  {"timestamp_operacion": clock.at(as_of)})


# --- C2: two-table inserts -------------------------------------------------


def admit_residents(t: Tables, requests: DataFrame, as_of) -> Result:
    """New residents, each with an optional principal caregiver (column
    ``id_cuidador``); a bad caregiver refuses the resident too."""
    today = clock.day(as_of)
    rows = requests.withColumns({"fecha_ingreso": today, "activo": F.lit(True)})
    columns = [c for c in t["residente"].columns if c != "id_residente"]
    rows = _checked(rows, t, "residente", as_of, columns)
    staff = t["staff"].select(F.col("id_staff").alias("id_cuidador"), F.lit(True).alias("_known"))
    rows = rows.join(staff, "id_cuidador", "left").withColumn("_error", F.coalesce(
        "_error", F.when(F.col("id_cuidador").isNotNull() & F.col("_known").isNull(),
                         F.lit(ERROR + "id_staff_referencia")))).drop("_known")
    accepted = dense_ids(rows.where(F.col("_error").isNull()), "change_id", "id_residente",
                         highest(t["residente"], "id_residente"))
    residents = accepted.select(*t["residente"].columns)
    created = _Later(lambda: {"residente": residents, "asignacion": dense_ids(
        accepted.where(F.col("id_cuidador").isNotNull()), "change_id",
        "id_asignacion", highest(t["asignacion"], "id_asignacion")).select(
        "id_asignacion", "id_residente", F.col("id_cuidador").alias("id_staff"),
        F.lit("Cuidador").alias("tipo_rol"), today.alias("fecha_inicio"),
        F.lit(None).cast("date").alias("fecha_fin"), F.lit(True).alias("es_principal"))})
    ids = accepted.select("change_id", "id_residente")
    outcome = _outcome(
        rows.join(ids, "change_id", "left"), F.col("_error"),
        F.concat(F.lit("Residente registrado con ID "), F.col("id_residente").cast("string")))
    return Result(_appended(t, created), outcome, created=created)


def _free_names(pdf: pd.DataFrame) -> list:
    seen: tuple[set, set] = (set(), set())
    accepted = []
    for change_id, *names in zip(pdf["change_id"], pdf["email"], pdf["username"]):
        if not any(name in used for name, used in zip(names, seen)):
            accepted.append(change_id)
            for name, used in zip(names, seen):
                used.add(name)
    return accepted


def hire_staff(t: Tables, requests: DataFrame, as_of, block: int = BLOCK) -> Result:
    """New staff with a user each; email and username must be free, counting
    requests accepted earlier in the batch."""
    rows = requests.withColumns({"activo": F.lit(True), "fecha_alta": clock.day(as_of)})
    rows = _checked(rows, t, "staff", as_of, [c for c in t["staff"].columns if c != "id_staff"])
    staff_error = F.col("_error")
    user_rules = {n: c for n, c in checks.row_rules(
        "usuario_sistema", as_of, ["username", "password_hash"]).items()}
    broken = checks.broken_rules(user_rules)
    rows = rows.withColumn("_error", F.coalesce(staff_error, F.when(
        F.size(broken) > 0, F.concat(F.lit(ERROR), F.array_join(broken, ", ")))))
    for table, column in (("staff", "email"), ("usuario_sistema", "username")):
        taken = t[table].select(column).distinct().withColumn("_taken", F.lit(True))
        rows = rows.join(taken, column, "left").withColumn("_error", F.coalesce(
            "_error", F.when(F.col("_taken"), F.lit(f"{ERROR}{column}_unico")))).drop("_taken")
    valid = rows.where(F.col("_error").isNull()).select("change_id", "email", "username")

    def blocked(pending: DataFrame, taken: DataFrame) -> DataFrame:
        return (pending.join(taken.select("email"), "email", "left_semi").select("change_id")
                .unionByName(pending.join(taken.select("username"), "username", "left_semi")
                             .select("change_id")).distinct())

    def places(pending: DataFrame) -> DataFrame:
        return pending.select("change_id", F.explode(F.array(*[
            F.concat(F.lit(f"{c}:"), c) for c in ("email", "username")])).alias("_place"))

    winners = accept_in_order(valid, "change_id", places, blocked, _free_names, block).withColumn("_won", F.lit(True))
    rows = rows.join(winners, "change_id", "left").withColumn("_error", F.coalesce(
        "_error", F.when(F.col("_won").isNull(), F.lit(ERROR + "email_o_username_unico"))))
    accepted = dense_ids(rows.where(F.col("_error").isNull()), "change_id", "id_staff",
                         highest(t["staff"], "id_staff"))
    staff = accepted.select(*t["staff"].columns)
    # One numbering for both: the users follow the staff.
    first, last = (highest(t[x], k) for x, k in (("staff", "id_staff"), ("usuario_sistema", "id_usuario")))
    users = accepted.select(
        (F.col("id_staff") - first + last).cast("bigint").alias("id_usuario"), "username", "password_hash", "id_staff",
        F.lit(True).alias("activo"), F.lit(None).cast("timestamp_ntz").alias("ultimo_login"))
    created = {"staff": staff, "usuario_sistema": users}
    outcome = _outcome(
        rows.join(accepted.select("change_id", "id_staff"), "change_id", "left"), F.col("_error"),
        F.concat(F.lit("Personal registrado con ID "), F.col("id_staff").cast("string")))
    return Result(_appended(t, created), outcome, created=created)


# --- C3: guarded updates ---------------------------------------------------


def update(t: Tables, table: str, key: str, columns: list[str], requests: DataFrame, as_of,
           missing: str, success: str, guard: Column | None = None,
           audited: bool = False) -> Result:
    """Set ``columns`` of the addressed rows to the requested values.

    A request for a row that does not exist (or fails ``guard``, a condition on
    the stored row) changes nothing. Several requests for one row all succeed
    and the last one stands.
    """
    stored = t[table]
    targets = stored if guard is None else stored.where(guard)
    rows = _checked(requests, t, table, as_of, columns)
    rows = rows.join(targets.select(key, F.lit(True).alias("_found")), key, "left")
    failure = F.coalesce(F.when(F.col("_found").isNull(), F.lit(missing)), F.col("_error"))
    if audited:
        rows = _actor_error(rows, t)
        failure = F.coalesce(failure, F.col("_actor_error"))
    if table == "staff" and "email" in columns:
        rows = _email_taken(rows, stored)
        failure = F.coalesce(failure, F.col("_email_error"))
    rows = rows.withColumn("_failure", failure)
    applied = rows.where(F.col("_failure").isNull())
    final = latest_per_key(applied, [key], "change_id", "change_id").select(
        key, F.struct(*columns).alias("_new"))
    snapshot = stored.join(final, key, "left").select(*[
        (F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
         if c in columns else F.col(c)) for c in stored.columns])
    return Result({table: snapshot}, _outcome(rows, F.col("_failure"), F.lit(success)),
                  _audit(applied, table, key, "UPDATE", as_of) if audited else None)


def _email_taken(rows: DataFrame, staff: DataFrame) -> DataFrame:
    """An email is refused when another staff member holds it in the stored
    table or an earlier request of the batch asked for it for someone else."""
    holders = staff.select(F.col("email"), F.col("id_staff").alias("_holder"))
    firsts = rows.groupBy("email").agg(
        F.min_by("id_staff", "change_id").alias("_first"))
    return rows.join(holders, "email", "left").join(firsts, "email", "left").withColumn(
        "_email_error", F.when((F.col("_holder") != F.col("id_staff"))
                               | (F.col("_first") != F.col("id_staff")),
                               F.lit(ERROR + "email_unico"))).drop("_holder", "_first")


def update_residents(t: Tables, requests: DataFrame, as_of) -> Result:
    return update(t, "residente", "id_residente",
                  ["habitacion", "diagnostico_principal", "nivel_movilidad", "contacto_emergencia",
                   "tel_emergencia"], requests, as_of, "Residente no encontrado o inactivo.",
                  "Residente actualizado.", guard=F.col("activo"), audited=True)


def update_staff(t: Tables, requests: DataFrame, as_of) -> Result:
    return update(t, "staff", "id_staff",
                  ["nombre", "apellidos", "especialidad", "email", "id_rol"], requests, as_of,
                  "Personal no encontrado.", "Personal actualizado.", audited=True)


def update_sessions(t: Tables, requests: DataFrame, as_of) -> Result:
    return update(t, "sesion_terapia", "id_sesion", ["asistio", "notas"], requests, as_of,
                  "Sesión no encontrada.", "Sesión actualizada.")


def update_incidents(t: Tables, requests: DataFrame, as_of) -> Result:
    return update(t, "reporte_incidente", "id_incidente", ["tipo", "descripcion", "severidad"],
                  requests, as_of, "Incidente no encontrado.", "Incidente actualizado.")


# --- C4: toggles -----------------------------------------------------------


def toggle_staff(t: Tables, requests: DataFrame, as_of) -> Result:
    """Flip ``activo`` once per request: an odd number of requests flips it."""
    staff = t["staff"]
    rows = _actor_error(requests, t).join(
        staff.select("id_staff", F.lit(True).alias("_found")), "id_staff", "left")
    rows = rows.withColumn("_failure", F.coalesce(
        F.when(F.col("_found").isNull(), F.lit("Personal no encontrado.")),
        F.col("_actor_error")))
    applied = rows.where(F.col("_failure").isNull())
    flips = applied.groupBy("id_staff").agg((F.count(F.lit(1)) % 2 == 1).alias("_flip"))
    snapshot = staff.join(flips, "id_staff", "left").withColumn(
        "activo", F.when(F.coalesce("_flip", F.lit(False)), ~F.col("activo")).otherwise(
            F.col("activo"))).select(*staff.columns)
    return Result({"staff": snapshot},
                  _outcome(rows, F.col("_failure"), F.lit("Estado del personal actualizado.")),
                  _audit(applied, "staff", "id_staff", "UPDATE", as_of))


# --- C5, C10: deletes ------------------------------------------------------

PROTECTED = {"log_medicamento": "El log de medicamentos es inmutable. No se permite DELETE."}


def delete(t: Tables, table: str, match: list[str], requests: DataFrame, missing: str,
           success: str) -> Result:
    """Delete the rows equal to a request in every ``match`` column. The first
    request for a row deletes it, later ones find nothing."""
    if table in PROTECTED:
        raise ValueError(f"{table} is append-only; see guard_deletes")
    stored = t[table]
    hits = requests.join(stored.select(*match).distinct(), match, "left_semi")
    firsts = hits.groupBy(*match).agg(F.min("change_id").alias("change_id"))
    outcome = _outcome(
        requests.select("change_id").join(
            firsts.select("change_id", F.lit(True).alias("_done")), "change_id", "left"),
        F.when(F.col("_done").isNull(), F.lit(missing)), F.lit(success))
    return Result({table: stored.join(firsts.select(*match), match, "left_anti").select(
        *stored.columns)}, outcome)


def delete_incidents(t: Tables, requests: DataFrame) -> Result:
    return delete(t, "reporte_incidente", ["id_incidente"], requests, "Incidente no encontrado.",
                  "Incidente eliminado.")


def delete_sessions(t: Tables, requests: DataFrame) -> Result:
    """Only the session's own therapist may delete it."""
    return delete(t, "sesion_terapia", ["id_sesion", "id_terapeuta"], requests,
                  "Sesión no encontrada o no pertenece a este terapeuta.", "Sesión eliminada.")


def guard_deletes(t: Tables, table: str, key: str, requests: DataFrame) -> Result:
    """A batch that would delete even one row of a protected table is
    refused as a whole; requests that match nothing are harmless."""
    stored = t[table]
    hits = requests.join(stored.select(key), key, "left_semi").agg(
        F.count(F.lit(1)).alias("n")).scalar()
    refused = F.when(hits > 0, F.lit(ERROR + PROTECTED[table]))
    return Result({table: stored}, _outcome(requests, refused, F.lit("Sin cambios.")))


# --- C6: soft delete -------------------------------------------------------


def discharge_residents(t: Tables, requests: DataFrame, as_of) -> Result:
    """Mark residents inactive and end their open assignments today.

    An assignment must end after it began, so one that started today or later
    refuses the whole discharge.
    """
    today = clock.day(as_of)
    still_open = t["asignacion"].where(F.col("fecha_fin").isNull())
    too_young = still_open.where(F.col("fecha_inicio") >= today).select("id_residente").distinct()
    rows = (
        _actor_error(requests, t)
        .join(t["residente"].select("id_residente", F.lit(True).alias("_found")), "id_residente",
              "left")
        .join(too_young.withColumn("_young", F.lit(True)), "id_residente", "left")
    )
    rows = rows.withColumn("_failure", F.coalesce(
        F.when(F.col("_found").isNull(), F.lit("Residente no encontrado.")),
        F.when(F.col("_young"), F.lit(ERROR + "fechas_orden")), F.col("_actor_error")))
    applied = rows.where(F.col("_failure").isNull())
    gone = applied.select("id_residente").distinct().withColumn("_gone", F.lit(True))
    left = F.coalesce("_gone", F.lit(False))
    residents = t["residente"].join(gone, "id_residente", "left").withColumn(
        "activo", F.col("activo") & ~left).select(*t["residente"].columns)
    assignments = t["asignacion"].join(gone, "id_residente", "left").withColumn(
        "fecha_fin", F.when(left & F.col("fecha_fin").isNull(), today).otherwise(
            F.col("fecha_fin"))).select(*t["asignacion"].columns)
    return Result({"residente": residents, "asignacion": assignments},
                  _outcome(rows, F.col("_failure"), F.lit("Residente dado de baja correctamente.")),
                  _audit(applied, "residente", "id_residente", "UPDATE", as_of))


# --- C7: booking -----------------------------------------------------------

THERAPIST_BUSY = "El terapeuta ya tiene una sesión en ese horario."
ROOM_BUSY = "La sala ya está ocupada en ese horario."
BOOKED = "Sesión registrada correctamente."


def _spans(df: DataFrame) -> DataFrame:
    return df.withColumn("_end", clock.plus_minutes(F.col("fecha_sesion"), F.col("duracion_min")))


def booking_conflicts(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with the number of stored sessions in the way, per therapist
    (``conflictos_terapeuta``) and per room (``conflictos_sala``)."""
    stored = _spans(sessions.select("id_terapeuta", "id_sala", "fecha_sesion", "duracion_min"))
    return overlap.overlap_counts(
        _spans(requests), stored, "change_id",
        {"conflictos_terapeuta": "id_terapeuta", "conflictos_sala": "id_sala"}, "fecha_sesion",
        "_end").drop("_end")


def _free_slots(pdf: pd.DataFrame) -> list:
    """Accepted intervals of one resource never overlap, so only the held
    interval starting last before a request's end can be in its way."""
    held: dict = {}
    accepted = []
    for change_id, therapist, room, start, end in zip(
            pdf["change_id"], pdf["id_terapeuta"], pdf["id_sala"], pdf["fecha_sesion"],
            pdf["_end"]):
        lines = [held.setdefault(r, []) for r in (("t", therapist), ("s", room))]
        spots = [bisect.bisect_left(line, (end,)) for line in lines]
        if all(i == 0 or line[i - 1][1] <= start for line, i in zip(lines, spots)):
            accepted.append(change_id)
            for line, i in zip(lines, spots):
                line.insert(i, (start, end))
    return accepted


def book_sessions(t: Tables, requests: DataFrame, as_of, block: int = BLOCK) -> Result:
    """Reserve sessions in request order; the therapist is checked before the
    room, against stored sessions and against earlier accepted requests."""
    stored = t["sesion_terapia"]
    columns = ["id_residente", "id_terapeuta", "id_sala", "fecha_sesion", "tipo_sesion",
               "duracion_min"]
    rows = materialise(_checked(booking_conflicts(requests, stored), t, "sesion_terapia", as_of,
                                columns))
    live = _spans(rows.where(
        F.col("_error").isNull() & (F.col("conflictos_terapeuta") == 0)
        & (F.col("conflictos_sala") == 0)
    ).select("change_id", "id_terapeuta", "id_sala", "fecha_sesion", "duracion_min")).drop(
        "duracion_min")
    unit = overlap.time_unit(_spans(rows), "fecha_sesion", "_end")
    window = ("fecha_sesion", "_end")

    def blocked(pending: DataFrame, taken: DataFrame) -> DataFrame:
        return overlap.overlap_hits(pending, taken, "change_id",
                                    {"_t": "id_terapeuta", "_s": "id_sala"}, *window).select(
            "change_id")

    def places(pending: DataFrame) -> DataFrame:
        # Overlapping sessions share an hour of their room or therapist.
        first, last = (F.floor(clock.epoch_micros(F.col(c)) / F.lit(3_600_000_000)) for c in window)
        return pending.withColumn("_hour", F.explode(F.sequence(first, last))).select(
            "change_id", F.explode(F.array(*[
                F.struct(F.lit(r).alias("kind"), F.col(r).alias("resource"), "_hour")
                for r in ("id_terapeuta", "id_sala")])).alias("_place"))

    accepted_ids = accept_in_order(live, "change_id", places, blocked, _free_slots, block)
    accepted = live.join(accepted_ids, "change_id", "left_semi")
    refused = _spans(rows.join(accepted_ids, "change_id", "left_anti"))
    # Accepted requests are in the way of later ones whatever else is wrong
    # with those; the lowest overlapping key tells whether it came earlier.
    for resource in ("id_terapeuta", "id_sala"):
        first = overlap.earliest_among(refused, accepted, "change_id", resource, *window,
                                       f"_by_{resource}", unit, LONGEST_SESSION)
        rows = rows.join(first, "change_id", "left")
    rows = rows.withColumn("_failure", F.coalesce(
        F.when((F.col("conflictos_terapeuta") > 0)
               | (F.col("_by_id_terapeuta") < F.col("change_id")), F.lit(THERAPIST_BUSY)),
        F.when((F.col("conflictos_sala") > 0)
               | (F.col("_by_id_sala") < F.col("change_id")), F.lit(ROOM_BUSY)),
        F.col("_error")))
    booked = rows.where(F.col("_failure").isNull()).withColumns({
        "asistio": F.lit(True), "notas": F.lit(None).cast("string")})
    created = _Later(lambda: {"sesion_terapia": dense_ids(
        booked, "change_id", "id_sesion", highest(stored, "id_sesion")).select(*stored.columns)})
    return Result(_appended(t, created), _outcome(rows, F.col("_failure"), F.lit(BOOKED)), created=created)


# --- C8: medication by tag scan --------------------------------------------

UNKNOWN_TAG = "Tag NFC no registrado."
NO_SCHEDULE = "No se encontró horario de medicamento activo para esta hora."


def confirm_medication(t: Tables, scans: DataFrame, as_of, wrap: bool = True) -> Result:
    """Log a dose per tag scan (change_id, codigo_tag, id_staff, escaneado_en):
    tag -> resident -> nearest active schedule within two hours of the scan's
    time of day. ``wrap`` lets 23:45 and 00:30 meet."""
    tags = t["nfc_tag"].select("codigo_tag", "id_tag", "id_residente")
    rows = scans.join(tags, "codigo_tag", "left")
    rows = rows.withColumn("_second", clock.seconds_of_day(F.col("escaneado_en")))
    schedules = t["horario_medicamento"].where(F.col("activo")).select(
        "id_residente", "id_horario", "hora_programada")
    rows = nearest_daily(rows, schedules, "id_residente", "_second", "hora_programada",
                         "id_horario", 7_200, wrap)
    staff = t["staff"].select("id_staff", F.lit(True).alias("_known"))
    rows = rows.join(staff, "id_staff", "left").withColumn("_failure", F.coalesce(
        F.when(F.col("id_tag").isNull(), F.lit(UNKNOWN_TAG)),
        F.when(F.col("id_horario").isNull(), F.lit(NO_SCHEDULE)),
        F.when(F.col("_known").isNull(), F.lit(ERROR + "id_cuidador_referencia"))))

    def logged() -> dict[str, DataFrame]:
        # One numbering for the doses and the scans that gave them.
        done = dense_ids(rows.where(F.col("_failure").isNull()), "change_id", "_number", F.lit(0)).withColumns({
            "id_log": F.col("_number") + highest(t["log_medicamento"], "id_log"),
            "id_evento": F.col("_number") + highest(t["nfc_evento"], "id_evento")})
        return {
            "log_medicamento": done.select(
                "id_log", "id_horario", F.col("id_staff").alias("id_cuidador"),
                F.col("escaneado_en").alias("fecha_administracion"), F.lit(None).cast("string").alias("incidente")),
            "nfc_evento": done.select("id_evento", "id_tag", "id_staff", "escaneado_en",
                                      F.col("id_log").alias("id_log_med"))}

    created = _Later(logged)
    outcome = _outcome(rows, F.col("_failure"), F.concat(
        F.lit("Medicamento registrado para residente ID "), F.col("id_residente").cast("string")))
    return Result(_appended(t, created), outcome, created=created)
