"""Time and calendar expressions. Instants are TIMESTAMP_NTZ in UTC; local wall clocks are TIMESTAMP_NTZ too.

Nothing here depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_local(utc: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def to_utc(local: Column, tz: str) -> Column:
    """The instant of a local time; of the two instants of a repeated local time, the first."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def exists_locally(local: Column, tz: str) -> Column:
    """False for the local times that a clock change skips."""
    return to_local(to_utc(local, tz), tz) == local


def plus(t: Column, seconds: Column | int) -> Column:
    return F.timestamp_add("SECOND", seconds if isinstance(seconds, Column) else F.lit(seconds), t)


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def epoch_seconds(t: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def floor_to(t: Column, seconds: int) -> Column:
    """The start of the step of ``seconds`` that holds t (for times since 1970)."""
    return plus(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), (F.floor(epoch_seconds(t) / seconds) * seconds).cast("long"))


def midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def issue_time(local_date: Column, tz: str, hour: int) -> Column:
    """When a day-ahead forecast for ``local_date`` is issued: the day before, ``hour`` local, in UTC."""
    return to_utc(plus(midnight(F.date_sub(local_date, 1)), hour * 3600), tz)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter: golden number, then the Paschal full moon from the epact, then the Sunday after it."""
    y = year.cast("int")
    golden, century = F.pmod(y, F.lit(19)), F.floor(y / 100)
    leap_drift = century - F.floor(century / 4)
    moon_drift = F.floor((8 * century + 13) / 25)
    epact = F.pmod(leap_drift - moon_drift + 19 * golden + 15, F.lit(30))
    moon = epact - F.floor(epact / 28) * (1 - F.floor(epact / 28) * F.floor(29 / (epact + 1)) * F.floor((21 - golden) / 11))
    weekday = F.pmod(y + F.floor(y / 4) + moon + 2 - leap_drift, F.lit(7))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def nth_weekday(year: Column, month: int, iso_weekday: int, n: int) -> Column:
    """The n-th given weekday (Monday 1) of a month."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(iso_weekday - 1) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
