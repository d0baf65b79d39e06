"""Table changes: hand-made cases and one-by-one brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import seed
from checks import change_checks
from checks.star import EVENTS_NOW, Derived
from seed import AS_OF, NOW
from vigilia.plans import changes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    out = seed.tables(spark)
    out["asignacion"] = out["asignacion"].withColumn("fecha_inicio", F.lit(seed.START))
    return out


def said(result):
    return {r.change_id: (r.ok, r.msg) for r in result.outcome.collect()}


def booking(spark, rows):
    return spark.createDataFrame(
        [(i, 1, th, room, ts, mins, "Individual") for i, th, room, ts, mins in rows],
        "change_id long, id_residente long, id_terapeuta long, id_sala long, "
        "fecha_sesion timestamp_ntz, duracion_min int, tipo_sesion string")


def test_booking_cases(spark, t):
    def at(day, hour, minute):
        return dt.datetime(2026, 3, day, hour, minute)

    got = said(changes.book_sessions(t, booking(spark, [
        (1, 1, 3, at(17, 10, 20), 30),    # therapist busy until 10:40
        (2, 1, 1, at(17, 10, 40), 30),    # touches: fine
        (3, 5, 2, at(10, 10, 10), 30),    # room busy
        (4, 5, 3, at(25, 9, 0), 60),
        (5, 5, 1, at(25, 9, 30), 60),     # loses to 4
        (6, 1, 1, at(25, 10, 0), 60),     # overlaps only the loser
        (7, 5, 3, at(26, 9, 0), 481)]), AS_OF))
    busy, room = (0, changes.THERAPIST_BUSY), (0, changes.ROOM_BUSY)
    booked = (1, changes.BOOKED)
    assert got == {1: busy, 2: booked, 3: room, 4: booked, 5: busy, 6: booked,
                   7: (0, "Error: duracion_rango")}


@pytest.mark.parametrize("small", [2, 50_000])
def test_booking_equals_one_by_one(spark, small):
    t = Derived(spark, SMALL, change_checks.ALL)
    t["staff"] = spark.range(1, 95).withColumnRenamed("id", "id_staff")
    t["sala"] = spark.range(1, 95).withColumnRenamed("id", "id_sala")
    got = said(changes.book_sessions(t, t["booking"], EVENTS_NOW, small))

    def spans(df):
        return [(r.id_terapeuta, r.id_sala, r.fecha_sesion,
                 r.fecha_sesion + dt.timedelta(minutes=r.duracion_min)) for r in df.collect()]

    held = spans(t["sesion_terapia"])
    staff = {r.id_staff for r in t["staff"].collect()}
    rooms = {r.id_sala for r in t["sala"].collect()}
    want = {}
    for r in sorted(t["booking"].collect(), key=lambda r: r.change_id):
        end = r.fecha_sesion + dt.timedelta(minutes=r.duracion_min)
        clash = [h for h in held if h[2] < end and h[3] > r.fecha_sesion]
        missing = [n for n, ok in (("id_terapeuta_referencia", r.id_terapeuta in staff),
                                   ("id_sala_referencia", r.id_sala in rooms)) if not ok]
        if any(h[0] == r.id_terapeuta for h in clash):
            want[r.change_id] = (0, changes.THERAPIST_BUSY)
        elif any(h[1] == r.id_sala for h in clash):
            want[r.change_id] = (0, changes.ROOM_BUSY)
        elif missing:
            want[r.change_id] = (0, "Error: " + ", ".join(missing))
        else:
            want[r.change_id] = (1, changes.BOOKED)
            held.append((r.id_terapeuta, r.id_sala, r.fecha_sesion, end))
    assert got == want and sum(ok for ok, _ in want.values()) > 10


@pytest.mark.parametrize("small", [4, 50_000])
def test_hiring_equals_one_by_one(spark, small):
    t = Derived(spark, SMALL, change_checks.ALL)
    result = changes.hire_staff(t, t["new_staff"], EVENTS_NOW, small)
    emails = {r.email for r in t["staff"].collect()}
    names = {r.username for r in t["usuario_sistema"].collect()}
    roles = {r.id_rol for r in t["rol"].collect()}
    want = set()
    for r in sorted(t["new_staff"].collect(), key=lambda r: r.change_id):
        if r.id_rol in roles and r.email not in emails and r.username not in names:
            want.add(r.change_id)
            emails.add(r.email)
            names.add(r.username)
    assert {c for c, (ok, _) in said(result).items() if ok} == want and len(want) > 5
    assert result.created["staff"].count() == len(want)
    assert result.created["usuario_sistema"].join(
        result.created["staff"], "id_staff", "left_semi").count() == len(want)


def test_tag_scans(spark, t):
    def scan(i, tag, hour, minute, staff=4):
        return (i, tag, staff, dt.datetime(2026, 3, 21, hour, minute))

    schema = "change_id long, codigo_tag string, id_staff long, escaneado_en timestamp_ntz"
    scans = spark.createDataFrame([
        scan(1, "TAG-S1", 8, 30), scan(2, "TAG-S1", 12, 0), scan(3, "TAG-S1", 5, 40),
        scan(4, "TAG-X", 9, 0), scan(5, "TAG-S1", 9, 0, staff=99)], schema)
    result = changes.confirm_medication(t, scans, AS_OF)
    done = (1, "Medicamento registrado para residente ID 3")
    assert said(result) == {1: done, 2: (0, changes.NO_SCHEDULE), 3: done,
                            4: (0, changes.UNKNOWN_TAG), 5: (0, "Error: id_cuidador_referencia")}
    assert {(r.id_log, r.id_horario) for r in result.created["log_medicamento"].collect()} == {
        (4, 3), (5, 3)}
    assert {(r.id_evento, r.id_log_med) for r in result.created["nfc_evento"].collect()} == {
        (2, 4), (3, 5)}
    late = {**t, "horario_medicamento": t["horario_medicamento"].withColumn(
        "hora_programada", F.lit(23 * 3600 + 45 * 60))}
    night = spark.createDataFrame([scan(1, "TAG-S1", 0, 30)], schema)
    assert said(changes.confirm_medication(late, night, AS_OF))[1] == done
    assert said(changes.confirm_medication(late, night, AS_OF, wrap=False))[1][0] == 0


def test_appends_and_admission(spark, t):
    checkins = spark.createDataFrame(
        [(1, 1, 4, 5, None), (2, 1, 4, 9, None), (3, 77, 4, 3, "x")],
        "change_id long, id_residente long, id_cuidador long, puntaje int, notas string")
    result = changes.add_checkins(t, checkins, AS_OF)
    assert said(result) == {1: (1, "Check-in registrado."), 2: (0, "Error: puntaje_rango"),
                            3: (0, "Error: id_residente_referencia")}
    assert [(r.id_checkin, r.fecha_registro) for r in
            result.created["checkin_estado_animo"].collect()] == [(6, NOW)]
    access = spark.createDataFrame([(1, 1, 4, None)], "change_id long, id_lector long, "
                                   "id_staff long, acceso_concedido boolean")
    assert changes.add_accesses(t, access, AS_OF).created["acceso_rfid"].first().acceso_concedido
    people = spark.createDataFrame(
        [(1, "A", "B", dt.date(1950, 1, 1), "F", "Asistido", 4),
         (2, "A", "B", dt.date(1970, 1, 1), "F", "Asistido", 4),
         (3, "A", "B", dt.date(1950, 1, 1), "F", "Asistido", 99),
         (4, "A", "B", dt.date(1950, 1, 1), "F", "Asistido", None)],
        "change_id long, nombre string, apellidos string, fecha_nacimiento date, sexo string, "
        "nivel_movilidad string, id_cuidador long")
    for c in ("habitacion", "diagnostico_principal", "contacto_emergencia", "tel_emergencia"):
        people = people.withColumn(c, F.lit(None).cast("string"))
    result = changes.admit_residents(t, people, AS_OF)
    assert said(result) == {
        1: (1, "Residente registrado con ID 6"), 2: (0, "Error: edad_minima"),
        3: (0, "Error: id_staff_referencia"), 4: (1, "Residente registrado con ID 7")}
    assert result.created["asignacion"].count() == 1


def test_discharge(spark, t):
    asked = spark.createDataFrame([(1, 1, 1), (2, 1, 88), (3, None, 2), (4, 1, 1)],
                                  "change_id long, actor_id long, id_residente long")
    result = changes.discharge_residents(t, asked, AS_OF)
    gone = (1, "Residente dado de baja correctamente.")
    assert said(result) == {1: gone, 2: (0, "Residente no encontrado."),
                            3: (0, "Error: id_usuario_referencia"), 4: gone}
    closed = result.tables["asignacion"].where("fecha_fin = DATE '2026-03-21'").collect()
    assert {r.id_residente for r in closed} == {1} and len(closed) == 3
    assert result.audit.count() == 2
    fresh = {**t, "asignacion": t["asignacion"].withColumn("fecha_inicio", F.lit(seed.TODAY))}
    refused = changes.discharge_residents(fresh, asked.where("change_id = 1"), AS_OF)
    assert said(refused)[1] == (0, "Error: fechas_orden")
    assert refused.tables["residente"].where("NOT activo").count() == 1


def test_updates_toggles_deletes(spark, t):
    edits = spark.createDataFrame(
        [(1, 1, 4, "x@x.org", 3), (2, 1, 4, "bruno@casa.example", 3), (3, 1, 5, "x@x.org", 3),
         (4, 1, 4, "y@x.org", 9), (5, 1, 4, "z@x.org", 2)],
        "change_id long, actor_id long, id_staff long, email string, id_rol long")
    for c in ("nombre", "apellidos", "especialidad"):
        edits = edits.withColumn(c, F.lit("n"))
    result = changes.update_staff(t, edits, AS_OF)
    assert {c: ok for c, (ok, _) in said(result).items()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    assert result.tables["staff"].where("id_staff = 4").first().email == "z@x.org"
    flips = spark.createDataFrame([(1, 1, 4), (2, 1, 4), (3, 1, 2), (4, 1, 44)],
                                  "change_id long, actor_id long, id_staff long")
    toggled = changes.toggle_staff(t, flips, AS_OF)
    assert {r.id_staff for r in toggled.tables["staff"].where("NOT activo").collect()} == {2, 5}
    drops = spark.createDataFrame([(1, 1, 3), (2, 1, 1), (3, 1, 1)],
                                  "change_id long, id_sesion long, id_terapeuta long")
    deleted = changes.delete_sessions(t, drops)
    assert {c: ok for c, (ok, _) in said(deleted).items()} == {1: 0, 2: 1, 3: 0}
    assert deleted.tables["sesion_terapia"].count() == 3
    logs = spark.createDataFrame([(1, 3), (2, 300)], "change_id long, id_log long")
    assert {ok for ok, _ in said(changes.guard_deletes(
        t, "log_medicamento", "id_log", logs)).values()} == {0}
    assert said(changes.guard_deletes(t, "log_medicamento", "id_log",
                                      logs.where("change_id = 2")))[2][0] == 1
    with pytest.raises(ValueError):
        changes.delete(t, "log_medicamento", ["id_log"], logs, "", "")
