"""Scalar, list and predicate functions of the query language."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import convert as _convert
from spindrift.functions._base import col, items, lit


def head(xs) -> Column:
    return F.try_element_at(items(xs), F.lit(1))


def last(xs) -> Column:
    return F.try_element_at(items(xs), F.lit(-1))


def tail(xs) -> Column:
    a = items(xs)
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def size(xs) -> Column:
    return F.size(items(xs))


def length(s) -> Column:
    return F.length(col(s))


def char_length(s) -> Column:
    return F.char_length(col(s))


def character_length(s) -> Column:
    return F.char_length(col(s))


def range_(start, end, step=1) -> Column:
    """Both ends are included."""
    return F.sequence(lit(start), lit(end), lit(step))


def keys(m) -> Column:
    return F.array_sort(F.map_keys(col(m)))


def exists(x) -> Column:
    return col(x).isNotNull()


def coalesce(*xs) -> Column:
    return F.coalesce(*map(col, xs))


def nullif(a, b) -> Column:
    return F.nullif(col(a), lit(b))


def is_empty(xs) -> Column:
    return F.size(items(xs)) == 0


def is_na_n(x) -> Column:
    return F.isnan(col(x))


def to_integer(x) -> Column:
    return _convert.to_integer(x)


def to_integer_or_null(x) -> Column:
    return _convert.to_integer(x)


def to_float(x) -> Column:
    return _convert.to_float(x)


def to_float_or_null(x) -> Column:
    return _convert.to_float(x)


def to_boolean(x) -> Column:
    return _convert.to_boolean(x)


def to_boolean_or_null(x) -> Column:
    return _convert.to_boolean(x)


def to_string(x) -> Column:
    return col(x).cast("string")


def to_string_or_null(x) -> Column:
    return col(x).cast("string")


def to_integer_list(xs) -> Column:
    return _convert.to_int_list(xs)


def to_float_list(xs) -> Column:
    return _convert.to_float_list(xs)


def to_boolean_list(xs) -> Column:
    return _convert.to_boolean_list(xs)


def to_string_list(xs) -> Column:
    return _convert.to_string_list(xs)


def value_type(x) -> Column:
    """Type name in the query language."""
    t = F.typeof(col(x))
    return (F.when(t.isin("tinyint", "smallint", "int", "bigint"), "INTEGER").when(t.isin("float", "double") | t.startswith("decimal"), "FLOAT")
            .when(t == "string", "STRING").when(t == "boolean", "BOOLEAN").when(t == "date", "DATE").when(t.startswith("timestamp"), "DATETIME")
            .when(t.startswith("array"), "LIST").when(t.startswith("map") | t.startswith("struct"), "MAP").when(t == "void", "NULL").otherwise(F.upper(t)))


def to_lower(s) -> Column:
    return F.lower(col(s))


def to_upper(s) -> Column:
    return F.upper(col(s))


def btrim(s) -> Column:
    return F.btrim(col(s))


def substring(s, start: int, length_: int | None = None) -> Column:
    """``start`` from 0."""
    return F.substr(col(s), F.lit(start + 1)) if length_ is None else F.substr(col(s), F.lit(start + 1), F.lit(length_))


def left(s, n: int) -> Column:
    return F.left(col(s), F.lit(n))


def right(s, n: int) -> Column:
    return F.right(col(s), F.lit(n))


def normalize(s, form: str = "NFC") -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.pandas_udf(run, "string")(col(s))


def round_(x) -> Column:
    """Halves away from zero."""
    return F.round(col(x))


def sign(x) -> Column:
    return F.signum(col(x)).cast("long")


def cot(x) -> Column:
    return 1 / F.tan(col(x))


def coth(x) -> Column:
    return 1 / F.tanh(col(x))


def haversin(x) -> Column:
    return (1 - F.cos(col(x))) / 2


def radians(x) -> Column:
    return F.radians(col(x))


def degrees(x) -> Column:
    return F.degrees(col(x))


def pi() -> Column:
    return F.pi()


def e() -> Column:
    return F.e()


def divide(a, b) -> Column:
    """Whole numbers divide to a whole number when exact; by zero is null."""
    x, y = col(a), lit(b)
    return F.try_divide(x, y)


def reduce(xs, initial, step) -> Column:
    return F.aggregate(items(xs), lit(initial), step)


def all_(xs, predicate) -> Column:
    return F.forall(items(xs), predicate)


def any_(xs, predicate) -> Column:
    return F.exists(items(xs), predicate)


def none(xs, predicate) -> Column:
    return ~F.exists(items(xs), predicate)


def single(xs, predicate) -> Column:
    return F.size(F.filter(items(xs), predicate)) == 1


def filter_(xs, predicate) -> Column:
    return F.filter(items(xs), predicate)


def extract(xs, change) -> Column:
    return F.transform(items(xs), change)


def regex_match(s, pattern: str) -> Column:
    """``=~``: the whole string matches."""
    return col(s).rlike(f"^(?:{pattern})$")


def date_truncate(unit: str, t) -> Column:
    return F.date_trunc(unit, col(t))


def duration_between(a, b) -> Column:
    """Days, seconds and microseconds from ``a`` to ``b``."""
    micros = F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))
    day = 86_400_000_000
    return F.struct((micros / day).cast("long").alias("days"), ((micros % day) / 1_000_000).cast("long").alias("seconds"), (micros % 1_000_000).alias("microseconds"))


def duration_in_days(a, b) -> Column:
    return F.datediff(col(b), col(a)).cast("long")


def duration_in_seconds(a, b) -> Column:
    return F.unix_seconds(col(b).cast("timestamp")) - F.unix_seconds(col(a).cast("timestamp"))


def duration_in_months(a, b) -> Column:
    return F.months_between(col(b), col(a)).cast("long")


def duration(text) -> Column:
    """ISO 8601 text (``P1Y2M3DT4H5M6S``) as an interval's parts."""
    part = lambda letter, of: F.coalesce(F.regexp_extract(of, rf"(-?[0-9.]+){letter}", 1).try_cast("double"), F.lit(0.0))
    days, time = F.split_part(col(text), F.lit("T"), F.lit(1)), F.split_part(col(text), F.lit("T"), F.lit(2))
    return F.struct(part("Y", days).alias("years"), part("M", days).alias("months"), part("W", days).alias("weeks"), part("D", days).alias("days"),
                    part("H", time).alias("hours"), part("M", time).alias("minutes"), part("S", time).alias("seconds"))
