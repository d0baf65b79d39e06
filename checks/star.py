"""The care and clinic tables as projections of the star-schema tables.

Customers stand for residents and patients, suppliers for staff, orders for
sessions and alerts, lineitem for assessments and events for every sensor and
care feed. Each definition is one projection in SQL that Spark and the oracle
engine both read, so the two sides start from the same rows.

A definition is (source, columns) with optional ``where`` and ``each`` (a
variable and the values each source row is repeated for). ``{ts}`` is the
zone-less timestamp type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilia.sources.tables import read_feed

STAR_TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}

# The instants reports are asked for: the star's order history and its event feed
# end at different times.
ORDERS_NOW = "2001-08-01 18:00:00"
EVENTS_NOW = "2024-01-30 18:00:00"
WEEK = "2024-01-22"

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
# lineitem repeats (order, line); the low digits keep such rows apart.
LINE_ID = ("((l_orderkey * 8 + l_linenumber) * 16777216 "
           f"+ (l_partkey * 1009 + l_suppkey * 9176 + {CENTS}) % 16777216)")


def _per(key: str, rows: int) -> str:
    return f"CAST(FLOOR({key} / {rows}) AS BIGINT)"


CLINIC = {
    "paciente": dict(source="customer", columns=dict(
        id_paciente="c_custkey", nombre="CONCAT('P', CAST(c_nationkey AS STRING))",
        apellidos="c_name", diagnostico_principal="c_mktsegment",
        id_cuidador=f"CASE WHEN c_custkey % 10 <> 0 THEN {_per('c_custkey', 15)} END",
        fecha_registro="CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INT) AS {ts})")),
    "sesion_psicologica": dict(source="orders", columns=dict(
        id_sesion="o_orderkey",
        id_paciente="o_custkey + CASE WHEN o_custkey % 10 = 3 THEN 1 ELSE 0 END",
        id_profesional=_per("o_custkey", 15), fecha_sesion="o_orderdate",
        duracion_min="CAST(15 + o_orderkey % 90 AS INT)",
        estado_emoc_inicio="CAST(NULLIF(o_orderkey % 11, 0) AS INT)",
        estado_emoc_fin="CAST(NULLIF((o_orderkey + o_custkey) % 11, 0) AS INT)")),
    "aplicacion_escala": dict(source="lineitem", columns=dict(
        id_aplicacion=LINE_ID, id_paciente="l_partkey", id_profesional="l_suppkey",
        id_sesion="l_orderkey", id_escala="CONCAT('E', CAST(l_suppkey % 5 AS STRING))",
        fecha_aplicacion="l_shipdate", puntaje_total="CAST(l_quantity AS INT)",
        nivel_riesgo="CASE WHEN l_returnflag = 'R' THEN 'Grave' WHEN l_returnflag = 'A' "
                     "THEN 'Moderado' WHEN l_linestatus = 'O' THEN 'Leve' ELSE 'Normal' END")),
    "escala_clinica": dict(source="region", columns=dict(
        id_escala="CONCAT('E', CAST(r_regionkey AS STRING))", nombre_escala="r_name",
        tipo="CONCAT('T', CAST(r_regionkey % 2 AS STRING))")),
    "alerta_riesgo": dict(source="orders", columns=dict(
        id_alerta="o_orderkey", id_paciente="o_custkey",
        id_aplicacion="CAST(NULL AS BIGINT)",
        id_prof_atiende=f"CASE WHEN o_orderkey % 4 <> 0 THEN {_per('o_orderkey', 150)} END",
        tipo_alerta="CONCAT('Evaluación E', CAST(o_orderkey % 5 AS STRING))",
        nivel_severidad="CASE WHEN o_orderpriority = '1-URGENT' THEN 'Grave' WHEN "
                        "o_orderpriority = '2-HIGH' THEN 'Moderado' WHEN o_orderpriority = "
                        "'3-MEDIUM' THEN 'Leve' ELSE 'Normal' END",
        descripcion="o_orderpriority",
        estado_alerta="CASE WHEN o_orderstatus = 'O' THEN 'Activa' WHEN o_orderstatus = 'F' "
                      "THEN 'Cerrada' ELSE 'Revisada' END",
        fecha_generacion="o_orderdate",
        fecha_resolucion="CASE WHEN o_orderstatus = 'F' THEN o_orderdate "
                         "+ (1 + o_orderkey % 300) * INTERVAL '1' HOUR END")),
    "profesional": dict(source="supplier", columns=dict(
        id_profesional="s_suppkey", nombre="CONCAT('D', CAST(s_nationkey AS STRING))",
        apellidos="s_name", especialidad="CONCAT('Esp', CAST(s_nationkey % 6 AS STRING))",
        id_rol="s_suppkey % 5", activo="s_acctbal >= 0")),
    "rol": dict(source="region", columns=dict(
        id_rol="CAST(r_regionkey AS BIGINT)", nombre_rol="r_name")),
    "cuidador": dict(source="supplier", columns=dict(
        id_cuidador="s_suppkey", nombre="CONCAT('C', CAST(s_nationkey AS STRING))",
        apellidos="s_name", telefono="CONCAT('33', CAST(s_suppkey AS STRING))")),
    "evento_gps": dict(source="events", columns=dict(
        id_dispositivo="user_id", id_paciente="user_id",
        latitud="CAST(20 + value / 1000 AS DECIMAL(10, 7))",
        longitud=f"CAST(-103 - {K} / 1000 AS DECIMAL(10, 7))", timestamp_evento="ts",
        dentro_zona_segura=f"value <= 100 AND {K} BETWEEN 20 AND 80")),
    "evento_nfc": dict(source="events", columns=dict(
        id_paciente="user_id", id_zona=f"CAST({K} % 25 AS BIGINT)", timestamp_evento="ts",
        tipo_evento="CASE WHEN event_type IN ('view', 'click', 'error') THEN 'Entrada' ELSE 'Salida' END")),
    "evento_beacon": dict(source="events", columns=dict(
        id_paciente="user_id", timestamp_evento="ts")),
    "zona": dict(source="nation", columns=dict(
        id_zona="CAST(n_nationkey AS BIGINT)", nombre_zona="n_name")),
    "log_auditoria": dict(source="events", columns=dict(
        id_usuario="user_id", operacion="upper(event_type)",
        tabla_afectada=f"CONCAT('tabla_', CAST({K} % 7 AS STRING))", timestamp_operacion="ts",
        ip_origen=f"CONCAT('10.0.0.', CAST({K} AS STRING))")),
    "dispositivo_iot": dict(source="customer_last_event", columns=dict(
        id_dispositivo="c_custkey",
        tipo_dispositivo="CASE WHEN c_custkey % 2 = 0 THEN 'GPS' ELSE 'NFC' END",
        identificador_hw="CONCAT('HW-', CAST(c_custkey AS STRING))",
        estado="CASE WHEN c_custkey % 6 = 0 THEN 'Inactivo' ELSE 'Activo' END",
        id_paciente="CASE WHEN c_custkey % 8 <> 0 THEN c_custkey END",
        ultima_conexion="last_ts")),
}

CARE = {
    "rol": dict(source="region", columns=dict(
        id_rol="CAST(r_regionkey + 1 AS BIGINT)", nombre_rol="r_name",
        nivel_acceso="CAST(LEAST(r_regionkey + 1, 3) AS INT)")),
    "ala": dict(source="nation", columns=dict(
        id_ala="CAST(n_nationkey + 1 AS BIGINT)", nombre="n_name",
        piso="CAST(n_regionkey + 1 AS INT)", descripcion="CAST(NULL AS STRING)", activa="TRUE")),
    "sala": dict(source="supplier", columns=dict(
        id_sala="s_suppkey + 1", nombre="CONCAT('Sala ', CAST(s_suppkey AS STRING))",
        id_ala="CAST(s_nationkey + 1 AS BIGINT)", capacidad="CAST(1 + s_suppkey % 8 AS INT)")),
    "limite_jardin": dict(source="region", columns=dict(
        id_limite="CAST(r_regionkey + 1 AS BIGINT)", descripcion="r_name",
        lat_min="CAST(20 + r_regionkey AS DECIMAL(10, 7))", lat_max="CAST(20.1 + r_regionkey AS DECIMAL(10, 7))",
        lon_min="CAST(-103.08 AS DECIMAL(10, 7))", lon_max="CAST(-103.02 AS DECIMAL(10, 7))")),
    "medicamento": dict(source="part", columns=dict(
        id_medicamento="p_partkey + 1", nombre="p_name", descripcion="p_type", unidad="'mg'")),
    "staff": dict(source="supplier", columns=dict(
        id_staff="s_suppkey + 1", nombre="CONCAT('S', CAST(s_nationkey AS STRING))",
        apellidos="s_name", especialidad="CONCAT('Esp', CAST(s_nationkey % 6 AS STRING))",
        email="CONCAT('s', CAST(s_suppkey AS STRING), '@example.org')",
        id_rol="1 + s_suppkey % 5", activo="s_acctbal >= 0",
        fecha_alta="DATE '2020-01-01' + CAST(s_suppkey % 1000 AS INT)")),
    "usuario_sistema": dict(source="supplier", each=("n", (1, 2)), columns=dict(
        id_usuario="s_suppkey * 2 + n",
        username="CONCAT('u', CAST(s_suppkey * 2 + n AS STRING))", password_hash="'x'",
        id_staff="s_suppkey + 1", activo="(s_suppkey * 2 + n) % 7 > 1",
        ultimo_login="CAST(NULL AS {ts})")),
    "residente": dict(source="customer", columns=dict(
        id_residente="c_custkey + 1", nombre="CONCAT('R', CAST(c_nationkey AS STRING))",
        apellidos="c_name",
        fecha_nacimiento="DATE '1930-01-01' + CAST(c_custkey * 97 % 12000 AS INT)",
        sexo="CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END",
        habitacion="CAST(100 + c_custkey % 900 AS STRING)", diagnostico_principal="c_mktsegment",
        nivel_movilidad="CASE WHEN c_custkey % 3 = 0 THEN 'Autonomo' WHEN c_custkey % 3 = 1 "
                        "THEN 'Asistido' ELSE 'Encamado' END",
        contacto_emergencia="CAST(NULL AS STRING)", tel_emergencia="CAST(NULL AS STRING)",
        fecha_ingreso="DATE '2019-01-01' + CAST(c_custkey % 1800 AS INT)",
        activo="c_acctbal >= 0")),
    "asignacion": dict(source="customer", each=("n", (0, 1, 2)), columns=dict(
        id_asignacion="c_custkey * 4 + n + 1", id_residente="c_custkey + 1",
        id_staff=f"{_per('c_custkey', 15)} + n + 1",
        tipo_rol="CASE WHEN n < 2 THEN 'Cuidador' ELSE 'Terapeuta' END",
        fecha_inicio="DATE '2022-01-01' + CAST(c_custkey % 300 AS INT)",
        fecha_fin="CASE WHEN (c_custkey + n) % 4 = 0 THEN DATE '2024-01-15' "
                  "+ CAST(c_custkey % 20 AS INT) END",
        es_principal="n = 0 AND c_custkey % 11 <> 0")),
    "turno": dict(source="supplier", each=("n", tuple(range(14))),
                  where="(s_suppkey + n) % 3 <> 0 AND (n < 7 OR s_suppkey % 5 = 0)", columns=dict(
        id_turno="s_suppkey * 14 + n + 1", id_staff="s_suppkey + 1",
        id_ala="CAST((s_nationkey + n) % 25 + 1 AS BIGINT)",
        fecha="DATE '2024-01-24' + CAST(n % 7 AS INT)",
        hora_inicio="CAST(25200 + 3600 * (s_suppkey % 8) AS INT)",
        hora_fin="CAST(54000 + 3600 * (s_suppkey % 8) AS INT)")),
    "sesion_terapia": dict(source="events", columns=dict(
        id_sesion="event_id + 1", id_residente="user_id + 1",
        id_terapeuta=f"CAST({K} + 1 AS BIGINT)",
        id_sala=f"CAST((user_id + {K}) % 100 + 1 AS BIGINT)", fecha_sesion="ts",
        tipo_sesion="CASE WHEN event_type = 'click' THEN 'Grupal' WHEN event_type = 'view' "
                    "THEN 'Virtual' ELSE 'Individual' END",
        duracion_min=f"15 + {K} % 90", asistio="value < 60", notas="event_type")),
    "checkin_estado_animo": dict(source="events", columns=dict(
        id_checkin="event_id + 1", id_residente="user_id + 1",
        id_cuidador=f"CAST({K} + 1 AS BIGINT)", fecha_registro="ts",
        puntaje="CAST(1 + FLOOR(value) % 5 AS INT)", notas="CAST(NULL AS STRING)")),
    "reporte_incidente": dict(source="events", columns=dict(
        id_incidente="event_id + 1", id_residente="user_id + 1",
        id_staff=f"CAST({K} + 1 AS BIGINT)", fecha="ts",
        tipo="CASE WHEN event_type = 'click' THEN 'Caida' WHEN event_type = 'error' THEN "
             "'Agitacion' WHEN event_type = 'purchase' THEN 'Deambulacion' WHEN event_type = "
             "'signup' THEN 'Rechazo_Medicamento' ELSE 'Otro' END",
        descripcion="props",
        severidad=f"CASE WHEN {K} % 3 = 0 THEN 'Alta' WHEN {K} % 3 = 1 THEN 'Media' "
                  "ELSE 'Baja' END")),
    "horario_medicamento": dict(source="customer", each=("n", (0, 1, 2)), columns=dict(
        id_horario="c_custkey * 3 + n + 1", id_residente="c_custkey + 1",
        id_medicamento="c_custkey + n + 1",
        hora_programada="CAST((c_custkey * 7 + n * 16) % 48 * 1800 AS INT)",
        dosis="CONCAT(CAST(10 * (n + 1) AS STRING), 'mg')",
        frecuencia="CASE WHEN n = 0 THEN 'Diaria' WHEN n = 1 THEN 'Semanal' ELSE 'Condicional' END",
        activo="(c_custkey + n) % 9 <> 0")),
    "log_medicamento": dict(source="events", columns=dict(
        id_log="event_id + 1", id_horario=f"user_id * 3 + {K} % 3 + 1",
        id_cuidador=f"CAST({K} + 1 AS BIGINT)", fecha_administracion="ts",
        incidente="CAST(NULL AS STRING)")),
    "gps_ping": dict(source="events", columns=dict(
        id_ping="event_id + 1", id_residente="user_id + 1",
        latitud="CAST(20 + value / 1000 AS DECIMAL(10, 7))",
        longitud=f"CAST(-103 - {K} / 1000 AS DECIMAL(10, 7))", registrado_en="ts")),
    "nfc_tag": dict(source="customer", columns=dict(
        id_tag="c_custkey + 1", codigo_tag="CONCAT('NFC-', CAST(c_custkey AS STRING))",
        id_residente="c_custkey + 1",
        descripcion="CONCAT('Estacion ', CAST(c_nationkey AS STRING))")),
    "nfc_evento": dict(source="events", columns=dict(
        id_evento="event_id + 1", id_tag="user_id + 1", id_staff=f"CAST({K} + 1 AS BIGINT)",
        escaneado_en="ts",
        id_log_med="CASE WHEN event_type = 'view' THEN event_id + 1 END")),
    "lector_rfid": dict(source="supplier", columns=dict(
        id_lector="s_suppkey + 1", ubicacion="CONCAT('Puerta ', CAST(s_suppkey AS STRING))",
        es_restringido="s_suppkey % 3 <> 0",
        id_ala="CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_nationkey + 1 AS BIGINT) END",
        id_sala="CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1 END")),
    "acceso_rfid": dict(source="events", columns=dict(
        id_acceso="event_id + 1", id_lector="user_id + 1", id_staff=f"CAST({K} + 1 AS BIGINT)",
        accedido_en="ts", acceso_concedido="value < 100")),
    "beacon": dict(source="nation", columns=dict(
        id_beacon="CAST(n_nationkey + 1 AS BIGINT)",
        id_ala="CAST((n_nationkey * 7) % 25 + 1 AS BIGINT)", nombre="CONCAT('Beacon-', n_name)")),
    "deteccion_beacon": dict(source="events", columns=dict(
        id_deteccion="event_id + 1", id_beacon="user_id % 25 + 1",
        id_staff=f"CAST({K} + 1 AS BIGINT)", detectado_en="ts")),
    "log_auditoria": dict(source="events", columns=dict(
        id_log="event_id + 1", id_usuario="user_id + 1",
        tabla_afectada=f"CASE WHEN {K} % 2 = 0 THEN 'residente' ELSE 'staff' END",
        operacion="CASE WHEN event_type = 'click' THEN 'INSERT' WHEN event_type = 'error' THEN "
                  "'DELETE' ELSE 'UPDATE' END",
        id_registro="event_id", ip_origen=f"CONCAT('10.0.0.', CAST({K} AS STRING))",
        timestamp_operacion="ts")),
}

LAST_EVENT_SQL = ("(SELECT c.*, e.last_ts FROM customer c LEFT JOIN (SELECT user_id, MAX(ts) AS "
                  "last_ts FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey)")


class Derived(dict):
    """Tables built on first use, so a query touches only what it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str, definitions: dict, live: bool = False):
        super().__init__()
        self.spark, self.sf_dir, self.definitions = spark, sf_dir, definitions
        self.live = live

    def _source(self, name: str) -> DataFrame:
        if name != "customer_last_event":
            if self.live:
                return read_feed(self.spark, self.sf_dir, STAR_TABLES[name],
                                 glob=f"{name}.parquet")
            return self.spark.read.schema(STAR_TABLES[name]).parquet(
                f"{self.sf_dir}/{name}.parquet")
        last = self._source("events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
        return self._source("customer").join(
            last.withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left")

    def __missing__(self, name: str) -> DataFrame:
        d = self.definitions[name]
        df = self._source(d["source"])
        if "each" in d:
            variable, numbers = d["each"]
            df = df.withColumn(variable, F.explode(F.array(*[F.lit(x) for x in numbers])))
        if "where" in d:
            df = df.where(d["where"])
        df = df.selectExpr(*[f"{e.format(ts='TIMESTAMP_NTZ')} AS {c}"
                             for c, e in d["columns"].items()])
        self[name] = df
        return df


def care(spark: SparkSession, sf_dir: str) -> Derived:
    return Derived(spark, sf_dir, CARE)


def clinic(spark: SparkSession, sf_dir: str) -> Derived:
    return Derived(spark, sf_dir, CLINIC)


def relation_sql(definitions: dict, name: str) -> str:
    """The same projection as a SQL subquery over the registered views."""
    d = definitions[name]
    columns = ", ".join(f"{e.format(ts='TIMESTAMP')} AS {c}" for c, e in d["columns"].items())
    source = LAST_EVENT_SQL if d["source"] == "customer_last_event" else d["source"]
    text = f"SELECT {columns} FROM {source}"
    if "each" in d:
        variable, numbers = d["each"]
        text += f" CROSS JOIN (SELECT UNNEST([{', '.join(map(str, numbers))}]) AS {variable})"
    if "where" in d:
        text += f" WHERE {d['where']}"
    return text


def with_tables(definitions: dict, names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named derived tables as CTEs; a body that opens
    CTEs of its own starts with ', '."""
    ctes = ", ".join(f"{n} AS ({relation_sql(definitions, n)})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body if body.startswith(',') else ' ' + body}"
