"""What the categories share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column from a column, a column's name or (for other values) a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def lit(x) -> Column:
    """A literal, unless it is a column already."""
    return x if isinstance(x, Column) else F.lit(x)


def items(xs) -> Column:
    """An array column from a column, its name or a Python list."""
    return F.array(*map(lit, xs)) if isinstance(xs, (list, tuple)) else col(xs)


def total(arr: Column) -> Column:
    """Sum of an array as double; empty: 0."""
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def without(m: Column, keys: Column) -> Column:
    """A map less some keys."""
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; of a key that both have, ``b``'s value."""
    return F.map_concat(without(a, F.map_keys(b)), b)
