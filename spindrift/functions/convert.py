"""Conversions.  What can't be converted is null, not 0 or false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def to_boolean(x) -> Column:
    s = F.lower(F.trim(col(x).cast("string")))
    return F.when(s.isin("true", "yes", "1"), F.lit(True)).when(s.isin("false", "no", "0"), F.lit(False))


def to_integer(x) -> Column:
    """Numbers in texts are cut towards zero."""
    return F.coalesce(col(x).try_cast("long"), col(x).try_cast("double").cast("long"))


def to_float(x) -> Column:
    return col(x).try_cast("double")


def to_string(x) -> Column:
    return col(x).cast("string")


def to_list(x) -> Column:
    return F.array(col(x))


def to_set(xs) -> Column:
    return F.array_distinct(items(xs))


def to_map(s) -> Column:
    """A struct or map as a map of strings."""
    return F.from_json(F.to_json(col(s)), "map<string,string>")


def to_json(x) -> Column:
    return F.to_json(col(x))


def from_json_list(s, of: str = "string") -> Column:
    return F.from_json(col(s), f"array<{of}>")


def from_json_map(s, of: str = "string") -> Column:
    return F.from_json(col(s), f"map<string,{of}>")


def from_json_node(s, properties: str = "map<string,string>") -> Column:
    return F.from_json(col(s), f"struct<id:string,labels:array<string>,properties:{properties}>")


def to_sorted_json_map(m) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(m)))))


def get_json_property(s, key: str) -> Column:
    return F.get_json_object(col(s), f"$.{key}")


def get_json_property_map(s, path: str) -> Column:
    return F.from_json(F.get_json_object(col(s), f"$.{path}"), "map<string,string>")


def set_json_property(s, key: str, value) -> Column:
    old = F.map_filter(F.from_json(col(s), "map<string,string>"), lambda k, _: k != key)
    return F.to_json(F.map_concat(old, F.create_map(F.lit(key), lit(value).cast("string"))))


def to_int_list(xs) -> Column:
    return F.transform(items(xs), lambda x: F.coalesce(x.try_cast("long"), x.try_cast("double").cast("long")))


def to_float_list(xs) -> Column:
    return F.transform(items(xs), lambda x: x.try_cast("double"))


def to_string_list(xs) -> Column:
    return F.transform(items(xs), lambda x: x.cast("string"))


def to_boolean_list(xs) -> Column:
    return F.transform(items(xs), to_boolean)
