"""Time expressions. Nothing here reads the wall clock: every report takes
``as_of`` so that one run of several reports sees one instant.

Timestamps are TIMESTAMP_NTZ; the session runs in UTC (`require_utc`), where
the zoned detours some Spark functions take are exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession, functions as F

SECONDS_PER_DAY = 86_400


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"zone-less timestamps need spark.sql.session.timeZone=UTC, not {zone}")


def at(moment: dt.datetime | dt.date | str) -> Column:
    """Literal zone-less timestamp."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def day(moment: dt.datetime | dt.date | str | Column) -> Column:
    """Literal date (the calendar day of ``moment``); a date column stays as it is."""
    return moment if isinstance(moment, Column) else F.lit(str(moment)[:10]).cast("date")


def ago(moment, **parts: int) -> Column:
    """``moment`` minus an interval, e.g. ``ago(as_of, days=7)``."""
    wanted = {k: F.lit(v) for k, v in parts.items()}
    return at(moment) - F.make_dt_interval(**wanted)


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(mins=minutes)


def since(ts: Column, as_of, **parts: int) -> Column:
    """Relative window without an upper bound: rows dated after ``as_of`` pass."""
    return ts >= ago(as_of, **parts)


def on_day(ts: Column, moment) -> Column:
    """Calendar-day filter; Spark turns the cast into a pushed-down range."""
    return F.to_date(ts) == day(moment)


def in_week(ts: Column, first_day) -> Column:
    """Seven calendar days from ``first_day``, both ends included."""
    return F.to_date(ts).between(day(first_day), F.date_add(day(first_day), 6))


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def minutes_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / F.lit(60_000_000.0)


def hours_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / F.lit(3_600_000_000.0)


def days_between(earlier: Column, later: Column) -> Column:
    return micros_between(earlier, later) / F.lit(86_400_000_000.0)


def whole_days(earlier: Column, later: Column) -> Column:
    """Elapsed full days toward zero: 36 hours count as one day."""
    return F.extract(F.lit("DAY"), later - earlier).cast("int")


def age_years(born: Column, as_of) -> Column:
    return F.timestamp_diff("YEAR", born, day(as_of)).cast("int")


def month_start(ts: Column) -> Column:
    """First day of the month as DATE (cheaper to group by than a string)."""
    return F.trunc(F.to_date(ts), "month")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_start(as_of) -> Column:
    """Monday of the week holding ``as_of``."""
    return F.trunc(day(as_of), "week")


def week_of(ts: Column) -> Column:
    """Monday of the week of every row."""
    return F.trunc(F.to_date(ts), "week")


def seconds_of_day(ts: Column) -> Column:
    """Second of the day with its fraction, exact."""
    micros = F.pmod(epoch_micros(ts), F.lit(86_400_000_000))
    return (micros.cast("decimal(14,0)") / F.lit(1_000_000)).cast("decimal(14,6)")


def minute_label(minute: Column) -> Column:
    """Minute of the day as HH:MM."""
    return F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# Text forms of dates and times (fixed values).
CLOCK = "hh:mm a"
DAY_LABEL = "dd MMM yyyy"
DAY_CLOCK = "dd MMM yyyy hh:mm a"
SHORT_DAY_CLOCK = "dd MMM hh:mm a"
DAY_CLOCK_24 = "dd MMM yyyy HH:mm"
DAY_SECONDS_24 = "dd MMM yyyy HH:mm:ss"
ISO_DAY = "yyyy-MM-dd"
