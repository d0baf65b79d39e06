"""Dimension listings (R36), each a table with at most a join or two."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilia.functions import clock, values as v
from vigilia.plans.views import Tables, ordered_by


def caregivers(t: Tables, ordered: bool = True) -> DataFrame:
    out = (
        t["staff"].where(F.col("activo"))
        .join(t["rol"].where(F.col("nivel_acceso") == 3).select("id_rol"), "id_rol", "left_semi")
    )
    out = ordered_by(out, ordered, F.asc("apellidos"))
    return out.select("id_staff",
                      v.full_name(F.col("nombre"), F.col("apellidos")).alias("nombre"))


def staff_with_role(t: Tables, ordered: bool = True) -> DataFrame:
    out = t["staff"].join(t["rol"], "id_rol").withColumn(
        "fecha_alta_fmt", F.date_format("fecha_alta", clock.DAY_LABEL))
    return ordered_by(out, ordered, F.asc("nivel_acceso"), F.asc("apellidos"))


def roles(t: Tables, ordered: bool = True) -> DataFrame:
    return ordered_by(t["rol"], ordered, F.asc("nivel_acceso"))


def readers(t: Tables, ordered: bool = True) -> DataFrame:
    out = (
        t["lector_rfid"]
        .join(t["ala"].select("id_ala", F.col("nombre").alias("ala")), "id_ala", "left")
        .join(t["sala"].select("id_sala", F.col("nombre").alias("sala")), "id_sala", "left")
    )
    return ordered_by(out, ordered, F.asc("id_lector"))


def active_staff(t: Tables, ordered: bool = True) -> DataFrame:
    out = t["staff"].where(F.col("activo")).join(t["rol"], "id_rol").select(
        "id_staff", "nombre", "apellidos", "nombre_rol")
    return ordered_by(out, ordered, F.asc("apellidos"))


def rooms(t: Tables, ordered: bool = True) -> DataFrame:
    wings = t["ala"].select("id_ala", F.col("nombre").alias("ala"))
    return ordered_by(t["sala"].join(wings, "id_ala", "left"), ordered, F.asc("nombre"))


def garden_limit(t: Tables) -> DataFrame:
    """The first garden limit."""
    return t["limite_jardin"].orderBy("id_limite").limit(1)
