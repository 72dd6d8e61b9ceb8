"""Aggregates, for ``groupBy().agg()`` and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col


def count(x) -> Column:
    return F.count(col(x))


def sum_(x) -> Column:
    return F.sum(col(x))


def avg(x) -> Column:
    return F.avg(col(x))


def min_(x) -> Column:
    return F.min(col(x))


def max_(x) -> Column:
    return F.max(col(x))


def collect(x) -> Column:
    """Sorted, so that a rerun agrees."""
    return F.array_sort(F.collect_list(col(x)))


def collect_distinct(x) -> Column:
    return F.array_sort(F.collect_set(col(x)))


def first(x, by) -> Column:
    return F.min_by(col(x), col(by))


def last(x, by) -> Column:
    return F.max_by(col(x), col(by))


def nth(x, by, n: int) -> Column:
    """Item ``n``, from 0, in order of ``by``; ties by the value."""
    return F.get(F.array_sort(F.collect_list(F.struct(col(by), col(x).alias("x")))), F.lit(n))["x"]


def slice_(x, by, start: int, length: int) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(col(by), col(x).alias("x"))))
    return F.transform(F.slice(ordered, start + 1, length), lambda s: s["x"])


def product(x) -> Column:
    return F.product(col(x))


def median(x) -> Column:
    return F.median(col(x))


def percentile(x, p: float) -> Column:
    """Interpolated; ``p`` is 0 to 1."""
    return F.percentile(col(x), p)


def percentile_cont(x, p: float) -> Column:
    return F.percentile(col(x), p)


def percentile_disc(x, p: float) -> Column:
    """The least value at or below which a share ``p`` of the values lies."""
    a = F.array_sort(F.collect_list(col(x)))
    return F.get(a, F.greatest(F.ceil(F.size(a) * p) - 1, F.lit(0)).cast("int"))


def stdev(x) -> Column:
    return F.stddev_pop(col(x))


def stdev_samp(x) -> Column:
    return F.stddev_samp(col(x))


def mode(x) -> Column:
    """The least of the most frequent values."""
    return F.mode(col(x), True)


def statistics(x) -> Column:
    c = col(x)
    return F.struct(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.avg(c).alias("mean"),
                    F.stddev_pop(c).alias("stdev"), F.var_pop(c).alias("variance"))


def min_items(x, n: int) -> Column:
    return F.slice(F.array_sort(F.collect_list(col(x))), 1, n)


def max_items(x, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(col(x)), asc=False), 1, n)


def histogram_bucket(x, width: float) -> Column:
    """Lower end of a value's bucket: group by it and count."""
    return F.floor(col(x) / width) * width
