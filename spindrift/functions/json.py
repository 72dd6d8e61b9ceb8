"""JSON texts, over the built-in parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def path(s, at: str) -> Column:
    return F.get_json_object(col(s), at if at.startswith("$") else f"$.{at}")


def validate(s) -> Column:
    return F.coalesce(F.try_parse_json(col(s)).isNotNull(), F.lit(False))


def parse(s) -> Column:
    return F.try_parse_json(col(s))


def stringify(x) -> Column:
    return F.to_json(col(x))


def compact(s) -> Column:
    return F.to_json(F.try_parse_json(col(s)))


def pretty(s) -> Column:
    return F.to_json(F.from_json(col(s), "map<string,string>"), {"pretty": "true"})


def keys(s) -> Column:
    return F.json_object_keys(col(s))


def values(s) -> Column:
    return F.map_values(F.from_json(col(s), "map<string,string>"))


def type_(s) -> Column:
    t = F.schema_of_variant(F.try_parse_json(col(s)))
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


def size(s) -> Column:
    return F.coalesce(F.json_array_length(col(s)), F.size(F.json_object_keys(col(s))))


def merge(a, *more) -> Column:
    """Later objects' entries win; values stay as they are written."""
    out = F.from_json(col(a), "map<string,string>")
    for m in more:
        other = F.from_json(col(m), "map<string,string>")
        out = F.map_concat(F.map_filter(out, lambda k, _, o=other: ~F.array_contains(F.map_keys(o), k)), other)
    return F.to_json(out)


def set_(s, key: str, value) -> Column:
    old = F.map_filter(F.from_json(col(s), "map<string,string>"), lambda k, _: k != key)
    return F.to_json(F.map_concat(old, F.create_map(F.lit(key), lit(value).cast("string"))))


def delete(s, key: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(col(s), "map<string,string>"), lambda k, _: k != key))


def filter_(s, predicate, of: str = "string") -> Column:
    return F.to_json(F.filter(F.from_json(col(s), f"array<{of}>"), predicate))


def map_(s, change, of: str = "string") -> Column:
    return F.to_json(F.transform(F.from_json(col(s), f"array<{of}>"), change))


def reduce(s, initial, merge_, of: str = "double") -> Column:
    return F.aggregate(F.from_json(col(s), f"array<{of}>"), lit(initial), merge_)


def from_values(xs) -> Column:
    return F.to_json(items(xs))
