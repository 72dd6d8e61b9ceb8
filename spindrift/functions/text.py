"""Strings, by code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def join(strings, delimiter: str) -> Column:
    return F.array_join(items(strings), delimiter)


def split(s, delimiter: str) -> Column:
    return F.split(col(s), re.escape(delimiter))


def replace(s, old, new) -> Column:
    return F.replace(col(s), lit(old), lit(new))


def regex_groups(s, pattern: str) -> Column:
    """For each match, the whole match and its groups."""
    groups = re.compile(pattern).groups
    found = [F.regexp_extract_all(col(s), F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
    return F.transform(found[0], lambda x, i: F.array(*(F.get(f, i) for f in found)))


def capitalize(s) -> Column:
    c = col(s)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def capitalize_all(s) -> Column:
    return F.upper(col(s))


def decapitalize(s) -> Column:
    c = col(s)
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def decapitalize_all(s) -> Column:
    return F.lower(col(s))


def swap_case(s) -> Column:
    chars = F.split(col(s), "")
    return F.array_join(F.transform(chars, lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def _words(s) -> Column:
    spaced = F.regexp_replace(col(s), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def upper_camel_case(s) -> Column:
    return F.array_join(F.transform(_words(s), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def camel_case(s) -> Column:
    return decapitalize(upper_camel_case(s))


def snake_case(s) -> Column:
    return F.array_join(F.transform(_words(s), F.lower), "_")


def clean(s) -> Column:
    return F.trim(F.regexp_replace(col(s), r"\s+", " "))


def compare_cleaned(a, b) -> Column:
    return F.lower(clean(a)) == F.lower(clean(b))


def distance(a, b) -> Column:
    return F.levenshtein(col(a), col(b))


def levenshtein_similarity(a, b) -> Column:
    n = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(col(a), col(b)) / n)


def fuzzy_match(a, b, threshold: float) -> Column:
    return levenshtein_similarity(a, b) >= threshold


def hamming_distance(a, b) -> Column:
    """Places that differ; -1 if the lengths do."""
    x, y = F.split(col(a), ""), F.split(col(b), "")
    n = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(col(a)) != F.length(col(b)), F.lit(-1)).otherwise(n)


def jaro_winkler_distance(a, b) -> Column:
    """Jaro-Winkler similarity (prefix weight 0.1, at most 4).

    A fold over the first string's characters: its state holds which of the
    second's are taken and the matches in order.
    """
    x, y = F.split(col(a), ""), F.split(col(b), "")
    n, m = F.length(col(a)), F.length(col(b))
    reach = F.greatest(F.floor(F.greatest(n, m) / 2) - 1, F.lit(0)).cast("int")
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("left"))
    indexed = F.transform(x, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def step(state, e):
        lo, hi = F.greatest(e["i"] - reach, F.lit(0)), F.least(e["i"] + reach, m - 1)
        free = F.filter(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda j: (F.get(y, j) == e["c"]) & ~F.array_contains(state["taken"], j))
        hit = F.size(free) > 0
        return F.struct(
            F.when(hit, F.concat(state["taken"], F.slice(free, 1, 1))).otherwise(state["taken"]).alias("taken"),
            F.when(hit, F.concat(state["left"], F.array(e["c"]))).otherwise(state["left"]).alias("left"))

    def score(state):
        k = F.size(state["left"])
        right = F.transform(F.array_sort(state["taken"]), lambda j: F.get(y, j))
        swaps = F.aggregate(F.zip_with(state["left"], right, lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda s, v: s + v) / 2
        jaro = F.when(k == 0, F.lit(0.0)).otherwise((k / n + k / m + (k - swaps) / k) / 3)
        same = F.aggregate(F.zip_with(F.slice(x, 1, 4), F.slice(y, 1, 4), lambda p, q: p == q), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                           lambda s, v: F.struct((s["n"] + F.when(s["on"] & F.coalesce(v, F.lit(False)), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(v, F.lit(False))).alias("on")), lambda s: s["n"])
        return jaro + same * 0.1 * (1 - jaro)

    value = F.aggregate(indexed, start, step, score)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(value)


def sorensen_dice_similarity(a, b) -> Column:
    """Shared letter pairs, counted as often as both have them."""
    def grams(c):
        n = F.greatest(F.length(c) - 1, F.lit(0))
        return F.transform(F.slice(F.sequence(F.lit(1), n + 1), F.lit(1), n), lambda i: F.lower(F.substr(c, i, F.lit(2))))

    x, y = grams(col(a)), grams(col(b))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(x, lambda v: v == g)), F.size(F.filter(y, lambda v: v == g))))
    n = F.size(x) + F.size(y)
    return F.when(col(a) == col(b), F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(2 * shared / n)


def lpad(s, length: int, pad: str = " ") -> Column:
    return F.lpad(col(s), length, pad)


def rpad(s, length: int, pad: str = " ") -> Column:
    return F.rpad(col(s), length, pad)


def format_(pattern: str, *args) -> Column:
    return F.format_string(pattern, *map(col, args))


def repeat(s, count: int) -> Column:
    return F.repeat(col(s), count)


def reverse(s) -> Column:
    return F.reverse(col(s))


def slug(s) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def trim(s) -> Column:
    return F.trim(col(s))


def ltrim(s) -> Column:
    return F.ltrim(col(s))


def rtrim(s) -> Column:
    return F.rtrim(col(s))


def urlencode(s) -> Column:
    return F.url_encode(col(s))


def urldecode(s) -> Column:
    return F.url_decode(col(s))


def base64_encode(s) -> Column:
    return F.base64(F.encode(col(s), "UTF-8"))


def base64_decode(s) -> Column:
    return F.decode(F.unbase64(col(s)), "UTF-8")


def index_of(s, part) -> Column:
    """First place of a part; -1 if absent."""
    return F.locate(part, col(s)).cast("long") - 1 if isinstance(part, str) else F.position(part, col(s)).cast("long") - 1


def indexes_of(s, part: str) -> Column:
    """All places of a part, overlapping ones too."""
    c, n = col(s), len(part)
    count = F.greatest(F.length(c) - n + 1, F.lit(0))
    return F.filter(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), lambda i: F.substr(c, i + 1, F.lit(n)) == part)


def code(s) -> Column:
    """Code point of the first character."""
    return F.conv(F.hex(F.encode(F.substring(col(s), 1, 1), "UTF-32")), 16, 10).cast("long")


def from_code_point(code_point) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(lit(code_point)), 8, "0")), "UTF-32")


def bytes_(s) -> Column:
    return F.encode(col(s), "UTF-8")


def bytes_to_string(b) -> Column:
    return F.decode(col(b), "UTF-8")


def phonetic(s) -> Column:
    return F.soundex(col(s))


def phonetic_delta(a, b) -> Column:
    """Places at which the two Soundex codes agree (0 to 4)."""
    x, y = F.split(F.soundex(col(a)), ""), F.split(F.soundex(col(b)), "")
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
