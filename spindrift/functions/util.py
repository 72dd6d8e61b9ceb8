"""Odds and ends."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def md5(x) -> Column:
    return F.md5(col(x).cast("string"))


def md5_hex(x) -> Column:
    return md5(x)


def md5_base64(x) -> Column:
    return F.base64(F.unhex(md5(x)))


def sha1(x) -> Column:
    return F.sha1(col(x).cast("string"))


def sha1_hex(x) -> Column:
    return sha1(x)


def sha1_base64(x) -> Column:
    return F.base64(F.unhex(sha1(x)))


def sha256(x) -> Column:
    return F.sha2(col(x).cast("string"), 256)


def sha256_hex(x) -> Column:
    return sha256(x)


def sha256_base64(x) -> Column:
    return F.base64(F.unhex(sha256(x)))


def validate(condition: Column, message: str) -> Column:
    return F.assert_true(condition, message)


def validate_pattern(s, pattern: str) -> Column:
    return col(s).rlike(f"^(?:{pattern})$")


def uuid() -> Column:
    return F.uuid()


def random_uuid() -> Column:
    return F.uuid()


def coalesce(*xs) -> Column:
    return F.coalesce(*map(col, xs))


def case(pairs, default=None) -> Column:
    """First value whose condition holds, from (condition, value) pairs."""
    (c, v), *rest = pairs
    out = F.when(c, lit(v))
    for c, v in rest:
        out = out.when(c, lit(v))
    return out.otherwise(lit(default))


def when(condition: Column, yes, no) -> Column:
    return F.when(condition, lit(yes)).otherwise(lit(no))


def type_of(x) -> Column:
    return F.typeof(col(x))


def repeat(x, count: int) -> Column:
    return F.array_repeat(lit(x), count)


def range_(start, end, step=1) -> Column:
    return F.sequence(col(start), col(end), col(step))


def partition(xs, size: int) -> Column:
    a = items(xs)
    return F.transform(F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(size))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, i, F.lit(size)))


def encode_base64(s) -> Column:
    return F.base64(F.encode(col(s), "UTF-8"))


def decode_base64(s) -> Column:
    return F.decode(F.unbase64(col(s)), "UTF-8")


def encode_url(s) -> Column:
    return F.url_encode(col(s))


def decode_url(s) -> Column:
    return F.url_decode(col(s))


def now() -> Column:
    return F.unix_millis(F.current_timestamp())


def now_in_seconds() -> Column:
    return F.unix_seconds(F.current_timestamp())


def timestamp() -> Column:
    return now()


def parse_timestamp(s) -> Column:
    return F.unix_seconds(F.try_to_timestamp(col(s)))


def format_timestamp(seconds, pattern: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), pattern)


def compress(s) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else zlib.compress(x.encode()))

    return F.pandas_udf(run, "binary")(col(s))


def decompress(b) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else zlib.decompress(x).decode())

    return F.pandas_udf(run, "string")(col(b))
