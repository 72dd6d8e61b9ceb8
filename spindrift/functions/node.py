"""Nodes as structs of ``id``, ``labels`` (array) and ``properties`` (map of texts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit, merged, without


def id_(n) -> Column:
    return col(n)["id"]


def labels(n) -> Column:
    return col(n)["labels"]


def properties(n) -> Column:
    return col(n)["properties"]


def property_(n, key) -> Column:
    """A property; null if the node lacks it."""
    return F.try_element_at(properties(n), lit(key))


def has_label(n, label) -> Column:
    return F.array_contains(labels(n), lit(label))


def has_labels(n, wanted) -> Column:
    """All of them."""
    return F.size(F.array_except(items(wanted), labels(n))) == 0


def to_map(n) -> Column:
    """Texts by ``id``, ``labels`` and ``properties``, the last two as JSON."""
    return F.create_map(F.lit("id"), id_(n).cast("string"), F.lit("labels"), F.to_json(labels(n)), F.lit("properties"), F.to_json(properties(n)))


def from_map(m) -> Column:
    """A node of what :func:`to_map` gives; its id is a text."""
    m = col(m)
    return F.struct(m["id"].alias("id"), F.from_json(m["labels"], "array<string>").alias("labels"), F.from_json(m["properties"], "map<string,string>").alias("properties"))


def set_property(n, key, value) -> Column:
    return set_properties(n, F.create_map(lit(key), lit(value).cast("string")))


def set_properties(n, more) -> Column:
    """New values replace those of the same key."""
    return col(n).withField("properties", merged(properties(n), col(more)))


def remove_property(n, key) -> Column:
    return remove_properties(n, [key])


def remove_properties(n, keys) -> Column:
    return col(n).withField("properties", without(properties(n), items(keys)))


def add_label(n, label) -> Column:
    return add_labels(n, [label])


def add_labels(n, more) -> Column:
    return col(n).withField("labels", F.array_union(labels(n), items(more)))


def remove_label(n, label) -> Column:
    return remove_labels(n, [label])


def remove_labels(n, some) -> Column:
    return col(n).withField("labels", F.array_except(labels(n), items(some)))


def clone(n, new_id) -> Column:
    """The same labels and properties under another id."""
    return col(n).withField("id", lit(new_id))


def diff(a, b) -> Column:
    """Properties of ``b`` that ``a`` lacks, of ``a`` that ``b`` lacks, and values that differ."""
    x, y = properties(a), properties(b)
    both = F.map_zip_with(x, y, lambda _, u, v: F.struct(u.alias("old"), v.alias("new")))
    changed = F.map_filter(both, lambda k, s: F.map_contains_key(x, k) & F.map_contains_key(y, k) & ~s["old"].eqNullSafe(s["new"]))
    return F.struct(without(y, F.map_keys(x)).alias("added"), without(x, F.map_keys(y)).alias("removed"), changed.alias("changed"))


def equals(a, b) -> Column:
    """Same id, labels in the same order, and properties."""
    d = diff(a, b)
    return id_(a).eqNullSafe(id_(b)) & labels(a).eqNullSafe(labels(b)) & (F.size(d["added"]) == 0) & (F.size(d["removed"]) == 0) & (F.size(d["changed"]) == 0)
