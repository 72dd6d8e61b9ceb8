"""Epoch seconds and date texts (UTC, patterns as Spark's)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def _ts(seconds) -> Column:
    return F.timestamp_seconds(col(seconds))


def parse(s, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.unix_seconds(F.try_to_timestamp(col(s), F.lit(pattern)))


def parse_as_zoned_date_time(s, pattern: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> Column:
    return parse(s, pattern)


def format_(seconds, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_ts(seconds), pattern)


def current_timestamp() -> Column:
    return F.unix_seconds(F.current_timestamp())


def field(seconds, name: str) -> Column:
    t = _ts(seconds)
    return {
        "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
        "weekday": lambda x: F.dayofweek(x) - 1, "dayofyear": F.dayofyear, "week": F.weekofyear,
    }[name](t)


def fields(seconds) -> Column:
    return F.struct(*(field(seconds, n).alias(n) for n in ("year", "month", "day", "hour", "minute", "second", "weekday", "dayofyear", "week")))


def add(seconds, amount, unit: str) -> Column:
    return col(seconds) + col(amount) * _UNITS[unit]


def convert(value, from_unit: str, to_unit: str) -> Column:
    return F.floor(col(value) * (_UNITS[from_unit] / _UNITS[to_unit])).cast("long")


def convert_format(s, from_pattern: str, to_pattern: str) -> Column:
    return F.date_format(F.try_to_timestamp(col(s), F.lit(from_pattern)), to_pattern)


def from_iso8601(s) -> Column:
    return F.unix_seconds(F.try_to_timestamp(col(s)))


def to_iso8601(seconds) -> Column:
    return F.date_format(_ts(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX")


def to_years(seconds) -> Column:
    return col(seconds) / (365.25 * 86400)


def system_timezone() -> Column:
    return F.current_timezone()


def to_unix_time(t) -> Column:
    return F.unix_seconds(col(t))


def from_unix_time(seconds) -> Column:
    return _ts(seconds)
