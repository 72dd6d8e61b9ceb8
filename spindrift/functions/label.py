"""Labels: arrays of names on nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def add(labels, label) -> Column:
    return F.array_union(items(labels), F.array(lit(label)))


def remove(labels, label) -> Column:
    return F.array_remove(items(labels), lit(label))


def replace(labels, new) -> Column:
    return F.array_distinct(items(new))


def set_(labels, new) -> Column:
    return F.array_distinct(items(new))


def clear(labels) -> Column:
    return F.array().cast("array<string>")


def merge(labels, more) -> Column:
    return F.array_union(items(labels), items(more))


def get(labels) -> Column:
    return F.array_sort(items(labels))


def has(labels, label) -> Column:
    return F.array_contains(items(labels), lit(label))


def has_any(labels, wanted) -> Column:
    return F.arrays_overlap(items(labels), items(wanted))


def has_all(labels, wanted) -> Column:
    return F.size(F.array_except(items(wanted), items(labels))) == 0


def union(a, b) -> Column:
    return F.array_union(items(a), items(b))


def intersection(a, b) -> Column:
    return F.array_intersect(items(a), items(b))


def diff(a, b) -> Column:
    return F.struct(F.array_except(items(a), items(b)).alias("only_left"), F.array_except(items(b), items(a)).alias("only_right"), F.array_intersect(items(a), items(b)).alias("common"))


def compare(a, b) -> Column:
    return diff(a, b)


def validate(label) -> Column:
    return col(label).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def normalize(label) -> Column:
    """Letters and digits only, each word with a capital."""
    words = F.filter(F.split(col(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def pattern(labels) -> Column:
    return F.array_join(F.transform(items(labels), lambda x: F.concat(F.lit(":"), x)), "")


def from_pattern(s) -> Column:
    return F.filter(F.split(col(s), ":"), lambda x: x != "")


def to_string(labels) -> Column:
    return pattern(labels)


def from_string(s) -> Column:
    return from_pattern(s)
