"""Number texts, bases and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import math as _math
from spindrift.functions._base import col


def format_(x, decimals: int = 2) -> Column:
    return F.format_number(col(x), decimals)


def parse(s) -> Column:
    return F.regexp_replace(col(s), ",", "").try_cast("double")


def parse_float(s) -> Column:
    return parse(s)


def parse_int(s, base: int = 10) -> Column:
    return from_base(s, base)


def exact(x) -> Column:
    return col(x).cast("decimal(38,18)").cast("string")


_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def romanize(x) -> Column:
    """1 to 3999; otherwise null."""
    n, parts = col(x).cast("int"), []
    for value, sign in _ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(n / value).cast("int")))
        n = n % value
    return F.when(col(x).between(1, 3999), F.concat(*parts))


def arabize(s) -> Column:
    values = F.transform(F.split(F.upper(col(s)), ""), lambda c: F.coalesce(*(F.when(c == k, F.lit(v)) for v, k in _ROMAN if len(k) == 1)))
    return F.aggregate(F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)


def to_base(x, base: int) -> Column:
    return F.lower(F.conv(col(x).cast("string"), 10, base))


def from_base(s, base: int) -> Column:
    return F.conv(col(s), base, 10).cast("long")


def to_hex(x) -> Column:
    return to_base(x, 16)


def from_hex(s) -> Column:
    return from_base(s, 16)


def to_octal(x) -> Column:
    return to_base(x, 8)


def from_octal(s) -> Column:
    return from_base(s, 8)


def to_binary(x) -> Column:
    return to_base(x, 2)


def from_binary(s) -> Column:
    return from_base(s, 2)


def round_(x, decimals: int = 0) -> Column:
    return _math.round_(x, decimals)


def ceil(x) -> Column:
    return _math.ceil(x)


def floor(x) -> Column:
    return _math.floor(x)


def abs_(x) -> Column:
    return _math.abs_(x)


def sign(x) -> Column:
    return F.signum(col(x)).cast("int")


def clamp(x, low, high) -> Column:
    return _math.clamp(x, low, high)


def lerp(a, b, t) -> Column:
    return _math.lerp(a, b, t)


def normalize(x, low, high) -> Column:
    return _math.normalize(x, low, high)


def map_(x, in_min, in_max, out_min, out_max) -> Column:
    return _math.normalize(x, in_min, in_max, out_min, out_max)


def is_even(x) -> Column:
    return col(x) % 2 == 0


def is_odd(x) -> Column:
    return col(x) % 2 != 0


def is_prime(x) -> Column:
    return _math.is_prime(x)


def gcd(a, b) -> Column:
    return _math.gcd(a, b)


def lcm(a, b) -> Column:
    return _math.lcm(a, b)


def factorial(x) -> Column:
    return _math.factorial(x)


def fibonacci(x) -> Column:
    return _math.fibonacci(x)


def power(x, y) -> Column:
    return _math.pow_(x, y)


def sqrt(x) -> Column:
    return _math.sqrt(x)


def log(x) -> Column:
    return _math.log(x)


def log10(x) -> Column:
    return _math.log10(x)


def exp(x) -> Column:
    return _math.exp(x)


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    return _math.random_int(low, high, seed)
