"""Types of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import scalar as _scalar
from spindrift.functions._base import col


def type_(x) -> Column:
    return _scalar.value_type(x)


def cypher_type(x) -> Column:
    return _scalar.value_type(x)


def type_of(x) -> Column:
    return F.typeof(col(x))


def is_type(x, name: str) -> Column:
    return _scalar.value_type(x) == name.upper()
