"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import items


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(items(a), items(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> Column:
    n = norm(a)
    return F.transform(items(a), lambda x: F.try_divide(x.cast("double"), n))


def similarity_cosine(a, b) -> Column:
    """0 where a vector is zero; null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(items(a)) == F.size(items(b)), F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), n)))


def distance_euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(items(a), items(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance_manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(items(a), items(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity_euclidean(a, b) -> Column:
    return F.when(F.size(items(a)) == F.size(items(b)), 1 / (1 + distance_euclidean(a, b)))
