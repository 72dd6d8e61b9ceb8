"""Functions on values whose results are known."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import call, coll, convert, hashing, math, registry, scalar, scoring, stats, text, xml


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit
CASES = [
    (lambda: coll.sum_([1, 2, 3]), 6.0), (lambda: coll.avg([1, 2, 3]), 2.0), (lambda: coll.contains([1, 2], 2), True), (lambda: coll.union([1, 2], [2, 3]), [1, 2, 3]),
    (lambda: coll.subtract([1, 2, 3], [2]), [1, 3]), (lambda: coll.split([1, 2, 3], 2), [[1, 2], [3]]), (lambda: coll.index_of([5, 6], 6), 1), (lambda: coll.index_of([5, 6], 7), -1),
    (lambda: coll.occurrences([1, 1, 2], 1), 2), (lambda: coll.remove([1, 2, 3], 1), [1, 3]), (lambda: coll.drop_duplicate_neighbors([1, 1, 2, 1]), [1, 2, 1]), (lambda: coll.pairs([1, 2, 3]), [[1, 2], [2, 3]]),
    (lambda: text.capitalize(L("hello")), "Hello"), (lambda: text.camel_case(L("hello big world")), "helloBigWorld"), (lambda: text.snake_case(L("HelloWorld")), "hello_world"),
    (lambda: text.distance(L("kitten"), L("sitting")), 3), (lambda: text.lpad(L("x"), 3, "-"), "--x"), (lambda: text.reverse(L("abc")), "cba"), (lambda: text.index_of(L("abc"), L("c")), 2),
    (lambda: text.hamming_distance(L("karolin"), L("kathrin")), 3), (lambda: text.base64_decode(text.base64_encode(L("hé"))), "hé"),
    (lambda: math.gcd(L(12), L(18)), 6), (lambda: math.lcm(L(4), L(6)), 12), (lambda: math.is_prime(L(97)), True), (lambda: math.factorial(L(5)), 120), (lambda: math.fibonacci(L(10)), 55),
    (lambda: math.clamp(L(11), 1, 10), 10), (lambda: math.median([1, 3, 2]), 2.0), (lambda: scalar.head([4, 5]), 4), (lambda: scalar.tail([4, 5, 6]), [5, 6]), (lambda: scalar.substring(L("hello"), 1, 3), "ell"),
    (lambda: scalar.to_integer(L("42")), 42), (lambda: scalar.to_boolean(L("true")), True), (lambda: scoring.jaccard([1, 2], [2, 3]), 1 / 3), (lambda: xml.strip_tags(L("<p>a<b>c</b></p>")), "ac"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_value(spark, i):
    made, want = CASES[i]
    got = value(spark, made())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_found_by_name(spark):
    assert len(registry()) > 400
    assert value(spark, call("coll.sum", [1, 2])) == 3.0
    with pytest.raises(KeyError):
        call("coll.nothing")


def test_nulls_pass(spark):
    null = F.lit(None).cast("string")
    for f in (text.capitalize, text.reverse, text.trim, text.slug, scalar.to_lower, convert.to_string):
        assert value(spark, f(null)) is None


def _fnv(raw, bits, xor_first):
    prime, h = (16777619, 2166136261) if bits == 32 else (1099511628211, 14695981039346656037)
    for b in raw:
        h = ((h ^ b) * prime if xor_first else (h * prime) ^ b) % (1 << bits)
    return h


def test_hashes_of_batches(spark):
    words = ["", "a", "foobar", "é" * 50, None, "chongo was here!"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    row = df.select("w", hashing.fnv1("w").alias("a"), hashing.fnv1a("w").alias("b"), hashing.fnv164("w").alias("c"), hashing.fnv1a64("w").alias("d")).collect()
    for r in row:
        want = [None if r["w"] is None else _fnv(r["w"].encode(), *k) for k in ((32, False), (32, True), (64, False), (64, True))]
        assert [None if v is None else int(v) for v in r[1:]] == want


def _jump(key, buckets):
    b, j, key = -1, 0, key % (1 << 64)
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**62, None, *range(10, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", hashing.jump_hash("k", 7).alias("seven"), hashing.jump_hash("k", 8).alias("eight"), hashing.jump_hash("k", 0).alias("none")).collect()
    for r in rows:
        if r["k"] is None:
            assert r[1:] == (None, None, None)
        else:
            assert r[1:] == (_jump(r["k"], 7), _jump(r["k"], 8), -1) and r["eight"] in (r["seven"], 7)
    assert len({r["eight"] for r in rows}) == 9


def test_bins_and_outliers(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)] + [("b", 5.0), ("b", 5.0)], "g string, x double")
    got = sorted((r["g"], r["x"] or 0, r["bin"], r["far"]) for r in df.select("g", "x", stats.histogram_bin("x", 4, "g").alias("bin"), stats.outlier("x", "g").alias("far")).collect())
    assert got == [("a", 0, None, None), ("a", 1, 0, False), ("a", 2, 0, False), ("a", 3, 0, False), ("a", 4, 0, False), ("a", 100, 3, True), ("b", 5, 0, False), ("b", 5, 0, False)]
