"""Statistics, as aggregates and as expressions over windows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from spindrift.functions._base import col


def mean(x) -> Column:
    return F.avg(col(x))


def median(x) -> Column:
    return F.median(col(x))


def mode(x) -> Column:
    return F.mode(col(x), True)


def std_dev(x) -> Column:
    return F.stddev_pop(col(x))


def variance(x) -> Column:
    return F.var_pop(col(x))


def percentile(x, p: float) -> Column:
    """``p`` is 0 to 100."""
    return F.percentile(col(x), p / 100)


def quartiles(x) -> Column:
    q = F.percentile(col(x), [0.25, 0.5, 0.75])
    return F.struct(q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))


def iqr(x) -> Column:
    return F.percentile(col(x), 0.75) - F.percentile(col(x), 0.25)


def min_(x) -> Column:
    return F.min(col(x))


def max_(x) -> Column:
    return F.max(col(x))


def range_(x) -> Column:
    return F.max(col(x)) - F.min(col(x))


def sum_(x) -> Column:
    return F.sum(col(x))


def count(x) -> Column:
    return F.count(col(x))


def skewness(x) -> Column:
    """Adjusted for the sample's size; 0 below three values."""
    c, n = col(x), F.count(col(x))
    return F.when(n < 3, F.lit(0.0)).otherwise(F.coalesce(F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2), F.lit(0.0)))


def kurtosis(x) -> Column:
    """Excess, adjusted for the sample's size; 0 below four values."""
    c, n = col(x), F.count(col(x))
    return F.when(n < 4, F.lit(0.0)).otherwise(F.coalesce((n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6), F.lit(0.0)))


def correlation(x, y) -> Column:
    return F.corr(col(x), col(y))


def covariance(x, y) -> Column:
    return F.covar_pop(col(x), col(y))


def z_score(x, *keys) -> Column:
    """Within groups of ``keys``."""
    w = Window.partitionBy(*map(col, keys))
    return F.try_divide(col(x) - F.avg(col(x)).over(w), F.stddev_pop(col(x)).over(w))


def normalize(x, *keys) -> Column:
    w = Window.partitionBy(*map(col, keys))
    low, high = F.min(col(x)).over(w), F.max(col(x)).over(w)
    return F.try_divide(col(x) - low, high - low)


def summary(x) -> Column:
    c = col(x)
    return F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stdev"), F.min(c).alias("min"), F.percentile(c, 0.25).alias("q1"),
                    F.median(c).alias("median"), F.percentile(c, 0.75).alias("q3"), F.max(c).alias("max"))


def histogram_bin(x, bins: int, *keys) -> Column:
    """The bin, from 0, of each value among ``bins`` of one width between the least and
    the greatest of its group; the greatest is in the last.  All alike: bin 0."""
    w = Window.partitionBy(*map(col, keys))
    low, high = F.min(col(x)).over(w), F.max(col(x)).over(w)
    at = F.floor(F.try_divide(col(x) - low, (high - low) / F.lit(float(bins))))
    return F.when(col(x).isNotNull(), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1))).cast("int")


def outlier(x, *keys, reach: float = 1.5) -> Column:
    """Whether a value lies more than ``reach`` times the middle half's width outside it."""
    w = Window.partitionBy(*map(col, keys))
    low, high = F.percentile(col(x), 0.25).over(w), F.percentile(col(x), 0.75).over(w)
    return (col(x) < low - reach * (high - low)) | (col(x) > high + reach * (high - low))
