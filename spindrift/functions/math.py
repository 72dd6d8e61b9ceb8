"""Numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, total


def max_long() -> Column:
    return F.lit(2**63 - 1)


def min_long() -> Column:
    return F.lit(-(2**63))


def max_double() -> Column:
    return F.lit(1.7976931348623157e308)


def min_double() -> Column:
    return F.lit(4.9e-324)


def round_(x, precision: int = 0) -> Column:
    return F.round(col(x).cast("double"), precision)


def ceil(x) -> Column:
    return F.ceil(col(x))


def floor(x) -> Column:
    return F.floor(col(x))


def abs_(x) -> Column:
    return F.abs(col(x))


def pow_(x, y) -> Column:
    return F.pow(col(x), col(y))


def sqrt(x) -> Column:
    return F.sqrt(col(x))


def log(x) -> Column:
    return F.ln(col(x))


def log10(x) -> Column:
    return F.log10(col(x))


def exp(x) -> Column:
    return F.exp(col(x))


def sin(x) -> Column:
    return F.sin(col(x))


def cos(x) -> Column:
    return F.cos(col(x))


def tan(x) -> Column:
    return F.tan(col(x))


def asin(x) -> Column:
    return F.asin(col(x))


def acos(x) -> Column:
    return F.acos(col(x))


def atan(x) -> Column:
    return F.atan(col(x))


def atan2(y, x) -> Column:
    return F.atan2(col(y), col(x))


def sinh(x) -> Column:
    return F.sinh(col(x))


def cosh(x) -> Column:
    return F.cosh(col(x))


def tanh(x) -> Column:
    return F.tanh(col(x))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(x) -> Column:
    return F.ln(col(x) / (1 - col(x)))


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def normalize(x, old_min, old_max, new_min=0.0, new_max=1.0) -> Column:
    return F.try_divide(col(x) - col(old_min), col(old_max) - col(old_min)) * (col(new_max) - col(new_min)) + col(new_min)


def gcd(a, b) -> Column:
    """Euclid's steps as a fold: 92 are enough for any two 64-bit numbers."""
    start = F.struct(F.abs(col(a).cast("long")).alias("a"), F.abs(col(b).cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a, b) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(col(a).cast("long")) / g).cast("long") * F.abs(col(b).cast("long")))


def factorial(n) -> Column:
    return F.factorial(col(n).cast("int"))


def fibonacci(n) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    return F.when(col(n) <= 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.sequence(F.lit(1), col(n).cast("int")), start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["a"]))


def is_prime(n) -> Column:
    """Trial division up to the root."""
    x = col(n).cast("long")
    root = F.floor(F.sqrt(x.cast("double"))).cast("long")
    return F.when(x < 2, F.lit(False)).when(x < 4, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(2).cast("long"), root), lambda d: x % d != 0))


def next_prime(n) -> Column:
    """The least prime over ``n``; a gap of 1,600 covers all 64-bit numbers."""
    x = F.greatest(col(n).cast("long"), F.lit(1).cast("long"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(1600).cast("long")), F.lit(None).cast("long"),
                       lambda s, d: F.when(s.isNotNull(), s).when(is_prime(x + d), x + d))


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    return (F.floor(F.rand(seed) * (high - low)) + low).cast("long")


def percentile(xs, p: float) -> Column:
    """Linear interpolation; ``p`` is 0 to 100."""
    a = F.array_sort(F.filter(items(xs), lambda x: x.isNotNull()))
    at = (F.size(a) - 1) * (p / 100)
    low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
    return F.when(F.size(a) > 0, low + (high - low) * (at - F.floor(at)))


def median(xs) -> Column:
    return percentile(xs, 50)


def mean(xs) -> Column:
    a = items(xs)
    return F.try_divide(total(a), F.size(a))


def variance(xs) -> Column:
    a = items(xs)
    m = mean(a)
    return F.try_divide(total(F.transform(a, lambda x: (x - m) * (x - m))), F.size(a))


def stdev(xs) -> Column:
    return F.sqrt(variance(xs))


def mode(xs) -> Column:
    """The most frequent value; the least of those on a tie."""
    a = items(xs)
    counted = F.transform(F.array_distinct(a), lambda v: F.struct((-F.size(F.filter(a, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def range_(start, end, step=1) -> Column:
    return F.sequence(col(start), col(end), col(step))


def sum_(xs) -> Column:
    return total(items(xs))


def product(xs) -> Column:
    return F.aggregate(items(xs), F.lit(1.0), lambda a, x: a * x.cast("double"))
