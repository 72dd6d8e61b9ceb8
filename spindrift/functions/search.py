"""Conditions on a property, which reach the scan where the source can use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, lit


def regex(x, pattern: str) -> Column:
    return col(x).rlike(pattern)


def prefix(x, text) -> Column:
    return F.startswith(col(x), lit(text))


def suffix(x, text) -> Column:
    return F.endswith(col(x), lit(text))


def contains(x, text) -> Column:
    return F.contains(col(x), lit(text))


def in_(x, values) -> Column:
    return col(x).isin(list(values))


def not_in(x, values) -> Column:
    return ~col(x).isin(list(values))


def exists(x) -> Column:
    return col(x).isNotNull()


def missing(x) -> Column:
    return col(x).isNull()


def null(x) -> Column:
    return col(x).isNull()


def not_null(x) -> Column:
    return col(x).isNotNull()


def node_all(criteria: dict) -> Column:
    """All properties have the given values."""
    return reduce(lambda a, b: a & b, (F.col(k) == lit(v) for k, v in criteria.items()), F.lit(True))


def node_any(criteria: dict) -> Column:
    """Some property has the given value."""
    return reduce(lambda a, b: a | b, (F.col(k) == lit(v) for k, v in criteria.items()), F.lit(False))


def match(x, wanted: str) -> Column:
    """The whole text matches a pattern in which ``*`` stands for any text."""
    return col(x).like(wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))
