"""Row, uniqueness and reference checks as violation tables (V1-V3).

All rules of a table are evaluated in one pass over it; a NULL outcome passes,
as in a database constraint. ``as_of`` stands for the current date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilia.sources.work import written


# Row rules (fixed values): table -> {rule: condition that must not be false}.
ROW_RULES = {
    "rol": {"nivel_acceso_rango": "nivel_acceso BETWEEN 1 AND 3"},
    "ala": {"piso_positivo": "piso > 0"},
    "sala": {"capacidad_positiva": "capacidad > 0"},
    "limite_jardin": {"latitud_orden": "lat_min < lat_max", "longitud_orden": "lon_min < lon_max"},
    "residente": {
        "sexo_valor": "sexo IN ('M', 'F')",
        "movilidad_valor": "nivel_movilidad IN ('Autonomo', 'Asistido', 'Encamado')",
        "edad_minima": "fecha_nacimiento <= add_months({today}, -720)",
    },
    "asignacion": {
        "tipo_rol_valor": "tipo_rol IN ('Cuidador', 'Terapeuta', 'Medico')",
        "fechas_orden": "fecha_fin IS NULL OR fecha_fin > fecha_inicio",
    },
    "turno": {"horas_orden": "hora_fin > hora_inicio"},
    "sesion_terapia": {
        "tipo_sesion_valor": "tipo_sesion IN ('Individual', 'Grupal', 'Virtual')",
        "duracion_rango": "duracion_min > 0 AND duracion_min <= 480",
    },
    "checkin_estado_animo": {"puntaje_rango": "puntaje BETWEEN 1 AND 5"},
    "reporte_incidente": {
        "tipo_valor":
            "tipo IN ('Caida', 'Agitacion', 'Deambulacion', 'Rechazo_Medicamento', 'Otro')",
        "severidad_valor": "severidad IN ('Baja', 'Media', 'Alta')",
    },
    "horario_medicamento": {
        "frecuencia_valor": "frecuencia IN ('Diaria', 'Semanal', 'Mensual', 'Condicional')",
    },
    "gps_ping": {
        "latitud_rango": "latitud BETWEEN -90 AND 90",
        "longitud_rango": "longitud BETWEEN -180 AND 180",
    },
    "log_auditoria": {"operacion_valor": "operacion IN ('INSERT', 'UPDATE', 'DELETE')"},
}

# Columns that must not be NULL and longest texts (fixed values).
REQUIRED = {
    "rol": "id_rol nombre_rol nivel_acceso",
    "ala": "id_ala nombre piso activa",
    "sala": "id_sala nombre id_ala capacidad",
    "limite_jardin": "id_limite lat_min lat_max lon_min lon_max",
    "medicamento": "id_medicamento nombre unidad",
    "staff": "id_staff nombre apellidos especialidad email id_rol activo fecha_alta",
    "usuario_sistema": "id_usuario username password_hash id_staff activo",
    "residente":
        "id_residente nombre apellidos fecha_nacimiento sexo nivel_movilidad fecha_ingreso activo",
    "asignacion": "id_asignacion id_residente id_staff tipo_rol fecha_inicio es_principal",
    "turno": "id_turno id_staff id_ala fecha hora_inicio hora_fin",
    "sesion_terapia":
        "id_sesion id_residente id_terapeuta id_sala fecha_sesion tipo_sesion duracion_min asistio",
    "checkin_estado_animo": "id_checkin id_residente id_cuidador fecha_registro puntaje",
    "reporte_incidente": "id_incidente id_residente id_staff fecha tipo descripcion severidad",
    "horario_medicamento":
        "id_horario id_residente id_medicamento hora_programada dosis frecuencia activo",
    "log_medicamento": "id_log id_horario id_cuidador fecha_administracion",
    "gps_ping": "id_ping id_residente latitud longitud registrado_en",
    "nfc_tag": "id_tag codigo_tag id_residente",
    "nfc_evento": "id_evento id_tag id_staff escaneado_en",
    "lector_rfid": "id_lector ubicacion es_restringido",
    "acceso_rfid": "id_acceso id_lector id_staff accedido_en acceso_concedido",
    "beacon": "id_beacon id_ala nombre",
    "deteccion_beacon": "id_deteccion id_beacon id_staff detectado_en",
    "log_auditoria": "id_log id_usuario tabla_afectada operacion timestamp_operacion",
}
LENGTHS = {
    "rol": {"nombre_rol": 50}, "ala": {"nombre": 80}, "sala": {"nombre": 80},
    "limite_jardin": {"descripcion": 100}, "medicamento": {"nombre": 100, "unidad": 20},
    "staff": {"nombre": 100, "apellidos": 100, "especialidad": 80, "email": 100},
    "usuario_sistema": {"username": 50, "password_hash": 255},
    "residente": {"nombre": 100, "apellidos": 100, "sexo": 1, "habitacion": 10,
                  "nivel_movilidad": 20, "contacto_emergencia": 100, "tel_emergencia": 15},
    "asignacion": {"tipo_rol": 20}, "sesion_terapia": {"tipo_sesion": 20},
    "reporte_incidente": {"tipo": 30, "severidad": 10},
    "horario_medicamento": {"dosis": 30, "frecuencia": 20},
    "nfc_tag": {"codigo_tag": 50, "descripcion": 100}, "lector_rfid": {"ubicacion": 100},
    "beacon": {"nombre": 80},
    "log_auditoria": {"tabla_afectada": 80, "operacion": 10, "ip_origen": 45},
}

# Unique keys: table -> column sets (fixed values).
UNIQUE = {
    "rol": [("id_rol",), ("nombre_rol",)], "ala": [("id_ala",), ("nombre",)],
    "sala": [("id_sala",), ("nombre",)], "limite_jardin": [("id_limite",)],
    "medicamento": [("id_medicamento",), ("nombre",)], "staff": [("id_staff",), ("email",)],
    "usuario_sistema": [("id_usuario",), ("username",)], "residente": [("id_residente",)],
    "asignacion": [("id_asignacion",)], "turno": [("id_turno",)],
    "sesion_terapia": [("id_sesion",)], "checkin_estado_animo": [("id_checkin",)],
    "reporte_incidente": [("id_incidente",)], "horario_medicamento": [("id_horario",)],
    "log_medicamento": [("id_log",)], "gps_ping": [("id_ping",)],
    "nfc_tag": [("id_tag",), ("codigo_tag",)], "nfc_evento": [("id_evento",)],
    "lector_rfid": [("id_lector",)], "acceso_rfid": [("id_acceso",)],
    "beacon": [("id_beacon",), ("nombre",)], "deteccion_beacon": [("id_deteccion",)],
    "log_auditoria": [("id_log",)],
}

# Foreign keys: table -> {column: (parent table, parent key)} (fixed values).
REFERENCES = {
    "sala": {"id_ala": ("ala", "id_ala")},
    "staff": {"id_rol": ("rol", "id_rol")},
    "usuario_sistema": {"id_staff": ("staff", "id_staff")},
    "asignacion": {"id_residente": ("residente", "id_residente"),
                   "id_staff": ("staff", "id_staff")},
    "turno": {"id_staff": ("staff", "id_staff"), "id_ala": ("ala", "id_ala")},
    "sesion_terapia": {"id_residente": ("residente", "id_residente"),
                       "id_terapeuta": ("staff", "id_staff"), "id_sala": ("sala", "id_sala")},
    "checkin_estado_animo": {"id_residente": ("residente", "id_residente"),
                             "id_cuidador": ("staff", "id_staff")},
    "reporte_incidente": {"id_residente": ("residente", "id_residente"),
                          "id_staff": ("staff", "id_staff")},
    "horario_medicamento": {"id_residente": ("residente", "id_residente"),
                            "id_medicamento": ("medicamento", "id_medicamento")},
    "log_medicamento": {"id_horario": ("horario_medicamento", "id_horario"),
                        "id_cuidador": ("staff", "id_staff")},
    "gps_ping": {"id_residente": ("residente", "id_residente")},
    "nfc_tag": {"id_residente": ("residente", "id_residente")},
    "nfc_evento": {"id_tag": ("nfc_tag", "id_tag"), "id_staff": ("staff", "id_staff"),
                   "id_log_med": ("log_medicamento", "id_log")},
    "lector_rfid": {"id_ala": ("ala", "id_ala"), "id_sala": ("sala", "id_sala")},
    "acceso_rfid": {"id_lector": ("lector_rfid", "id_lector"), "id_staff": ("staff", "id_staff")},
    "beacon": {"id_ala": ("ala", "id_ala")},
    "deteccion_beacon": {"id_beacon": ("beacon", "id_beacon"), "id_staff": ("staff", "id_staff")},
    "log_auditoria": {"id_usuario": ("usuario_sistema", "id_usuario")},
}


def row_rules(table: str, as_of, columns: Sequence[str] | None = None) -> dict[str, Column]:
    """Rule name -> condition; only rules over the given columns when listed."""
    today = f"DATE '{str(as_of)[:10]}'"
    rules = {name: F.expr(text.format(today=today))
             for name, text in ROW_RULES.get(table, {}).items()}
    for c in REQUIRED.get(table, "").split():
        if columns is None or c in columns:
            rules[f"{c}_requerido"] = F.col(c).isNotNull()
    for c, longest in LENGTHS.get(table, {}).items():
        if columns is None or c in columns:
            rules[f"{c}_largo"] = F.char_length(c) <= longest
    return rules


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, as an array."""
    names = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def row_violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """V1: a (key, regla) row per broken rule."""
    return df.select(F.col(key), F.explode(broken_rules(rules)).alias("regla"))


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V2: key values held by several rows, and how many. NULL is never equal
    to NULL, so rows with a NULL part cannot collide."""
    known = df
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("filas")).where(F.col("filas") > 1)


def already_stored(new: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V2: new rows whose key is already taken."""
    return new.join(stored.select(*columns), list(columns), "left_semi")


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """V3: foreign-key values without a parent and the rows holding them.

    Children are counted per value first: a value held by a third of the rows
    reaches the join as one row.
    """
    held = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("valor")).agg(
        F.count(F.lit(1)).alias("filas"))
    return held.join(parent.select(F.col(parent_key).alias("valor")), "valor", "left_anti")


def _facts(name: str, df: DataFrame, as_of) -> DataFrame:
    """(tabla, kind, regla, padre, valor, n): what one scan of a table tells: the
    rows that break each row rule, and the rows of each value of its unique keys
    and of its references, counted before they move."""
    text, none = F.lit, F.lit(None).cast("string")

    def fact(kind: str, rule: Column, parent: Column, value: Column) -> Column:
        return F.struct(text(kind).alias("kind"), rule.alias("regla"), parent.alias("padre"), value.alias("valor"))

    rules = row_rules(name, as_of)
    broken = F.transform(broken_rules(rules), lambda r: fact("row", r, none, none))
    keys = [fact("key", text("_".join(columns) + "_unico"), text(f"{name}.{'.'.join(columns)}"), _value(columns))
            for columns in UNIQUE.get(name, [])]
    links = [fact("link", text(f"{column}_referencia"), text(f"{parent}.{key}"), _value([column]))
             for column, (parent, key) in REFERENCES.get(name, {}).items()]
    known = F.filter(F.array(*keys, *links), lambda x: x["valor"].isNotNull())
    return df.select(F.explode(F.concat(broken, known)).alias("x")).groupBy(
        F.lit(name).alias("tabla"), "x.kind", "x.regla", "x.padre", "x.valor").agg(F.count(F.lit(1)).alias("n"))


def _value(columns: Sequence[str]) -> Column:
    """A key as text, NULL if a part is: parts with their lengths, which tells all keys apart."""
    parts = [F.col(c).cast("string") for c in columns]
    if len(parts) == 1:
        return parts[0]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def table_report(tables: Mapping[str, DataFrame], as_of) -> DataFrame:
    """Broken rules of every table at hand: (tabla, regla, filas).

    Each table is scanned once. References are checked against the values their
    parents' keys were counted with; a parent that is not at hand is not asked.
    """
    facts = None
    for name, df in tables.items():
        some = _facts(name, df, as_of)
        facts = some if facts is None else facts.unionByName(some)
    facts = written(facts, "rules")
    rows = facts.where("kind = 'row'").groupBy("tabla", "regla").agg(F.sum("n").alias("filas"))
    twice = facts.where("kind = 'key' AND n > 1").groupBy("tabla", "regla").agg(F.sum("n").alias("filas"))
    at_hand = [f"{t}.{'.'.join(k)}" for t in tables for k in UNIQUE.get(t, [])]
    held = facts.where("kind = 'key'").select("padre", "valor")
    lost = (facts.where((F.col("kind") == "link") & F.col("padre").isin(at_hand))
            .join(held, ["padre", "valor"], "left_anti").groupBy("tabla", "regla").agg(F.sum("n").alias("filas")))
    return rows.unionByName(twice).unionByName(lost)
