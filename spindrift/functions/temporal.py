"""Timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}


def _unit(unit: str) -> str:
    return unit.lower().rstrip("s")


def format_(t, pattern: str) -> Column:
    return F.date_format(col(t), pattern)


def parse(s, pattern: str) -> Column:
    return F.try_to_timestamp(col(s), F.lit(pattern))


def format_duration(seconds) -> Column:
    """``1h2m3s``, as seconds are given."""
    s = col(seconds).cast("long")
    return F.format_string("%dh%dm%ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def to_epoch_millis(t) -> Column:
    return F.unix_millis(col(t).cast("timestamp"))


def from_epoch_millis(ms) -> Column:
    return F.timestamp_millis(col(ms))


def add(t, amount, unit: str) -> Column:
    return F.timestamp_add(_unit(unit).upper(), col(amount).cast("int"), col(t))


def subtract(t, amount, unit: str) -> Column:
    return F.timestamp_add(_unit(unit).upper(), -col(amount).cast("int"), col(t))


def difference(a, b, unit: str) -> Column:
    """From ``a`` to ``b``, cut towards zero; months have 30 days, years 365."""
    micros = F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))
    return (micros / (_SECONDS[_unit(unit)] * 1_000_000)).cast("long")


def start_of(t, unit: str) -> Column:
    return F.date_trunc(_unit(unit), col(t))


def truncate(t, unit: str) -> Column:
    return start_of(t, unit)


def end_of(t, unit: str) -> Column:
    return F.timestamp_add(_unit(unit).upper(), F.lit(1), start_of(t, unit)) - F.expr("INTERVAL 1 MICROSECOND")


def round_(t, unit: str) -> Column:
    """The nearer unit boundary; the later one on a tie."""
    low = start_of(t, unit)
    high = F.timestamp_add(_unit(unit).upper(), F.lit(1), low)
    return F.when(F.unix_micros(col(t).cast("timestamp")) - F.unix_micros(low) < F.unix_micros(high) - F.unix_micros(col(t).cast("timestamp")), low).otherwise(high)


def is_between(t, start, end) -> Column:
    return col(t).between(col(start), col(end))


def day_of_week(t) -> Column:
    return F.dayofweek(col(t)) - 1


def quarter(t) -> Column:
    return F.quarter(col(t))


def age(born, now=None) -> Column:
    return F.floor(F.months_between(col(now) if now is not None else F.current_timestamp(), col(born)) / 12).cast("long")


def timezone(t, zone: str) -> Column:
    return F.from_utc_timestamp(col(t), zone)


def to_local(t) -> Column:
    return F.from_utc_timestamp(col(t), F.current_timezone())


def to_utc(t, zone: str = "UTC") -> Column:
    return F.to_utc_timestamp(col(t), zone)


def duration(amount, unit: str) -> Column:
    """Seconds."""
    return col(amount) * _SECONDS[_unit(unit)]


def is_weekend(t) -> Column:
    return F.weekday(col(t)) >= 5


def is_weekday(t) -> Column:
    return F.weekday(col(t)) < 5


def day_of_year(t) -> Column:
    return F.dayofyear(col(t))


def week_of_year(t) -> Column:
    return F.weekofyear(col(t))


def is_leap_year(year) -> Column:
    y = col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(year, month) -> Column:
    return F.day(F.last_day(F.make_date(col(year), col(month), F.lit(1))))
