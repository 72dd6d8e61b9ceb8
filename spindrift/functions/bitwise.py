"""Bits of 64-bit numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col


def _long(x) -> Column:
    return col(x).cast("long")


def and_(*xs) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), map(_long, xs))


def or_(*xs) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), map(_long, xs))


def xor(*xs) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), map(_long, xs))


def not_(x) -> Column:
    return F.bitwise_not(_long(x))


def left_shift(x, n: int) -> Column:
    return F.shiftleft(_long(x), n)


def right_shift(x, n: int) -> Column:
    return F.shiftright(_long(x), n)


def op(a, operation: str, b) -> Column:
    return {"&": and_, "AND": and_, "|": or_, "OR": or_, "^": xor, "XOR": xor, "<<": left_shift, ">>": right_shift}[operation.upper()](a, b)


def set_bit(x, n: int) -> Column:
    return _long(x).bitwiseOR(F.shiftleft(F.lit(1).cast("long"), n))


def clear_bit(x, n: int) -> Column:
    return _long(x).bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), n)))


def toggle_bit(x, n: int) -> Column:
    return _long(x).bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), n))


def test_bit(x, n: int) -> Column:
    return F.shiftright(_long(x), n).bitwiseAND(F.lit(1)) == 1


def count_bits(x) -> Column:
    return F.bit_count(_long(x))


def reverse_bits(x) -> Column:
    bits = F.lpad(F.bin(_long(x)), 64, "0")
    return F.conv(F.reverse(bits), 2, -10).cast("long")


def rotate_left(x, n: int) -> Column:
    n %= 64
    return _long(x) if not n else F.shiftleft(_long(x), n).bitwiseOR(F.shiftrightunsigned(_long(x), 64 - n))


def rotate_right(x, n: int) -> Column:
    return rotate_left(x, -n % 64)
