"""Date columns: league-local days, ages, clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAGUE_TIME_ZONE = "America/Argentina/Buenos_Aires"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def local_date(instant_utc: Column, time_zone: str = LEAGUE_TIME_ZONE) -> Column:
    """Calendar day of a UTC instant in the league's time zone."""
    wall_clock = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), instant_utc.cast("timestamp_ntz"))
    return F.to_date(wall_clock)


def iso_date(text: Column) -> Column:
    """Date of a strict ``YYYY-MM-DD`` text, null for anything else or a day that does not exist."""
    value = text.cast("string")
    return F.when(value.rlike(ISO_DATE), F.try_to_date(value, "yyyy-MM-dd"))


def age_on(birth: Column, day: Column) -> Column:
    """Completed years on ``day``; null for invalid births and ages outside 0..99."""
    born = iso_date(birth)
    before_birthday = (F.month(day) < F.month(born)) | (
        (F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born))
    )
    age = F.year(day) - F.year(born) - F.when(before_birthday, 1).otherwise(0)
    return F.when((age >= 0) & (age < 100), age)


def hhmm(time: Column) -> Column:
    """First five characters of a clock time, empty when missing."""
    return F.substring(F.coalesce(time.cast("string"), F.lit("")), 1, 5)


def clock(time: Column) -> Column:
    """``HH:mm:ss`` of a valid clock time given with or without seconds; null otherwise."""
    text = F.trim(time.cast("string"))
    padded = F.when(F.length(text) == 5, F.concat(text, F.lit(":00"))).otherwise(text)
    return F.when(padded.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), padded)


def calendar_key(date: Column, time: Column) -> Column:
    """Text that sorts like the calendar: date then time, missing parts first."""
    return F.concat(F.coalesce(date.cast("string"), F.lit("")), F.coalesce(time, F.lit("")))
