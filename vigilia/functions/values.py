"""Numbers, names, labels and bands as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def full_name(first: Column, last: Column) -> Column:
    """A missing part makes the whole name NULL."""
    return F.concat(first, F.lit(" "), last)


def name_of(prefix: str) -> Column:
    return full_name(F.col(f"{prefix}.nombre"), F.col(f"{prefix}.apellidos"))


def ratio(total: Column, count: Column, digits: int) -> Column:
    """``total / count`` rounded half away from zero, NULL for no rows.

    Both inputs are exact (integer or decimal) sums and the division happens
    once, so the result does not depend on the order rows arrived in.
    """
    return F.round(total.cast("double") / F.nullif(count, F.lit(0)), digits)


def mean(value: Column, digits: int) -> Column:
    """Mean of an integer column as an aggregate expression."""
    return ratio(F.sum(value.cast("bigint")), F.count(value), digits)


def mean_micros(micros: Column, unit: float, digits: int) -> Column:
    """Mean of microsecond spans in ``unit`` microseconds. The sum is decimal:
    a bigint sum of microseconds overflows at a billion long spans."""
    total = F.sum(micros.cast("decimal(20,0)")).cast("double")
    return F.round(total / F.nullif(F.count(micros), F.lit(0)) / F.lit(unit), digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def whole_percent(part: Column, whole: Column) -> Column:
    """Percent cut to an integer, 0 where there is nothing to divide by. The
    quotient is taken before scaling, so 29 of 100 gives 28 as in the report."""
    return F.when(whole > 0, (part / F.nullif(whole, F.lit(0)) * F.lit(100)).cast(
        "bigint")).otherwise(F.lit(0).cast("bigint"))


def rounded_int(value: Column) -> Column:
    """Numeric to integer by rounding; a bare cast would truncate."""
    return F.round(value).cast("int")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column) -> Column:
    """0/1 sum: unlike `count_if` it is NULL over no rows at all."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def inside_box(lat: Column, lon: Column, box: Column) -> Column:
    """Point in rectangle, edges included."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(
        box["lon_min"], box["lon_max"])


# Mood labels for scores 1..5 (fixed values).
MOOD_LABELS = ("Muy bajo", "Bajo", "Regular", "Bueno", "Excelente")


def mood_label(score: Column) -> Column:
    return F.when(score.between(1, 5), F.element_at(
        F.array(*[F.lit(x) for x in MOOD_LABELS]), F.greatest(F.least(score, F.lit(5)), F.lit(1))))


# Bands carry the badge names of the report pages (fixed values).
GOOD, WATCH, ALARM = "success", "warning", "danger"


def mood_band(score: Column) -> Column:
    return (F.when(score <= 2, ALARM).when(score <= 3, WATCH)
            .when(score.isNotNull(), GOOD))


def adherence_band(percentage: Column) -> Column:
    return (F.when(percentage >= 80, GOOD).when(percentage >= 50, WATCH)
            .when(percentage.isNotNull(), ALARM))


def adherence_class(index: Column) -> Column:
    """Class of a 0-100 adherence index; an unknown index falls to 'Alta'."""
    return (F.when(index == 0, "Nula").when(index < 50, "Baja").when(index < 80, "Media")
            .otherwise("Alta"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Alta", 1).when(severity == "Media", 2).otherwise(3)


def severity_band(severity: Column) -> Column:
    return (F.when(severity == "Alta", ALARM).when(severity == "Media", WATCH)
            .otherwise(GOOD))


def mobility_band(level: Column) -> Column:
    return (F.when(level == "Autonomo", GOOD).when(level == "Asistido", WATCH)
            .otherwise(ALARM))


def contains_text(query: str, columns: Sequence[str]) -> Column:
    """Case-insensitive search over the shown columns; '' keeps every row."""
    if not query:
        return F.lit(True)
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return F.lower(shown).contains(query.lower())


def tagged(column: str, tag: str) -> Column:
    """Exact tag filter; '' means all."""
    return F.col(column) == tag if tag else F.lit(True)
