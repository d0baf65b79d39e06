"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import care_checks, change_checks, clinic_checks, stream_checks

_MODULES = (care_checks, clinic_checks, change_checks, stream_checks)


def _in_utc(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Zone-less timestamps pass through zoned functions exactly only in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
