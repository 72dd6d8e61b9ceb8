"""Hashes.  Digests are built in; the others run over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, lit


def _text(x) -> Column:
    return col(x).cast("string")


def md5(x) -> Column:
    return F.md5(_text(x))


def sha1(x) -> Column:
    return F.sha1(_text(x))


def sha256(x) -> Column:
    return F.sha2(_text(x), 256)


def sha384(x) -> Column:
    return F.sha2(_text(x), 384)


def sha512(x) -> Column:
    return F.sha2(_text(x), 512)


def fingerprint(x) -> Column:
    return sha256(x)


def fingerprint_graph(x) -> Column:
    """Aggregate: a digest of rows in any order."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(F.sha2(_text(x), 256))), ""))


def crc32(x) -> Column:
    return F.crc32(_text(x))


def _fnv(x, bits: int, xor_first: bool) -> Column:
    """Byte by byte over all values of a batch at once."""
    kind, prime, start = (np.uint32, 16777619, 2166136261) if bits == 32 else (np.uint64, 1099511628211, 14695981039346656037)

    def run(s: pd.Series) -> pd.Series:
        from decimal import Decimal

        raw = [v.encode() for v in s.dropna()]
        size = np.array([len(r) for r in raw], np.int64)
        at, data = np.cumsum(size) - size, np.frombuffer(b"".join(raw), np.uint8)
        h, left = np.full(len(raw), start, kind), np.argsort(-size, kind="stable")
        with np.errstate(over="ignore"):
            for i in range(int(size.max(initial=0))):
                left = left[: np.searchsorted(-size[left], -i)]  # those longer than i
                byte = data[at[left] + i].astype(kind)
                h[left] = (h[left] ^ byte) * kind(prime) if xor_first else (h[left] * kind(prime)) ^ byte
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[s.notna()] = [Decimal(v) for v in h.tolist()]
        return out

    return F.pandas_udf(run, "decimal(20,0)")(_text(x))


def fnv1(x) -> Column:
    return _fnv(x, 32, False).cast("long")


def fnv1a(x) -> Column:
    return _fnv(x, 32, True).cast("long")


def fnv164(x) -> Column:
    return _fnv(x, 64, False)


def fnv1a64(x) -> Column:
    return _fnv(x, 64, True)


def xx_hash64(x, seed: int = 0) -> Column:
    """Unsigned, as a decimal; the built-in ``xxhash64`` has seed 42."""

    def run(s: pd.Series) -> pd.Series:
        from decimal import Decimal

        import xxhash

        return s.map(lambda v: None if v is None else Decimal(xxhash.xxh64_intdigest(v.encode(), seed)))

    return F.pandas_udf(run, "decimal(20,0)")(_text(x))


def xx_hash32(x, seed: int = 0) -> Column:
    def run(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda v: None if v is None else xxhash.xxh32_intdigest(v.encode(), seed)).astype("Int64")

    return F.pandas_udf(run, "long")(_text(x))


def murmur_hash3(x) -> Column:
    """32-bit, with the engine's own seed (42)."""
    return F.hash(_text(x))


def consistent_hash(x, buckets: int) -> Column:
    return F.pmod(F.xxhash64(_text(x)), lit(buckets)).cast("int")


def rendezvous_hash(x, nodes: list[str]) -> Column:
    """The node whose hash with the key is greatest: few keys move when nodes come or go."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(_text(x), F.lit(n)).alias("h"), F.lit(n).alias("node")) for n in nodes)))["node"]


def jump_hash(key, buckets: int) -> Column:
    """The bucket of a whole number; when there is one bucket more, keys move only to
    it.  Null keys have none; under one bucket the result is -1."""

    def run(s: pd.Series) -> pd.Series:
        h = s.dropna().to_numpy("int64").view(np.uint64)
        bucket, jump = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        left = np.flatnonzero(jump < buckets)
        with np.errstate(over="ignore"):
            h = h.copy()
            while len(left):
                bucket[left] = jump[left]
                h[left] = h[left] * np.uint64(2862933555777941757) + np.uint64(1)
                jump[left] = ((bucket[left] + 1) * (float(1 << 31) / ((h[left] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
                left = left[jump[left] < buckets]
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[s.notna()] = bucket
        return out

    return F.pandas_udf(run, "long")(col(key).cast("long"))
