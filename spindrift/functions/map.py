"""Maps.  A later entry of the same key wins, whatever the session's policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def _without(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def from_pairs(pairs) -> Column:
    """From an array of (key, value) structs; the last of a key counts."""
    p = items(pairs)
    last = F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.greatest(F.size(p), F.lit(1))), lambda o: o[_key(0)] == e[_key(0)]))
    return F.map_from_entries(last)


def _key(i: int) -> str:
    return ("key", "value")[i]


def from_lists(keys, values) -> Column:
    return F.map_from_arrays(items(keys), items(values))


def from_values(values) -> Column:
    """From an array of keys and values in turn."""
    v = items(values)
    n = F.floor(F.size(v) / 2).cast("int")
    places = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    return F.map_from_entries(F.transform(places, lambda i: F.struct(F.get(v, 2 * i), F.get(v, 2 * i + 1))))


def merge(a, b, *more) -> Column:
    out = F.map_concat(_without(col(a), F.map_keys(col(b))), col(b))
    for m in more:
        out = F.map_concat(_without(out, F.map_keys(col(m))), col(m))
    return out


def merge_list(maps, key_type: str = "string", value_type: str = "string") -> Column:
    empty = F.create_map().cast(f"map<{key_type},{value_type}>")
    return F.aggregate(items(maps), empty, lambda acc, m: F.map_concat(_without(acc, F.map_keys(m)), m))


def set_key(m, key, value) -> Column:
    return merge(m, F.create_map(lit(key), lit(value)))


def set_entry(m, key, value) -> Column:
    return set_key(m, key, value)


def set_pairs(m, pairs) -> Column:
    return merge(m, from_pairs(pairs))


def set_lists(m, keys, values) -> Column:
    return merge(m, from_lists(keys, values))


def set_values(m, values) -> Column:
    return merge(m, from_values(values))


def remove_key(m, key) -> Column:
    return F.map_filter(col(m), lambda k, _: k != lit(key))


def remove_keys(m, keys) -> Column:
    return _without(col(m), items(keys))


def clean(m, keys=(), values=()) -> Column:
    """Without null values, the given keys and the given values."""
    out = F.map_filter(col(m), lambda _, v: v.isNotNull())
    if keys:
        out = _without(out, items(list(keys)))
    if values:
        out = F.map_filter(out, lambda _, v: ~v.isin(*values))
    return out


def get(m, key, default=None) -> Column:
    return F.coalesce(F.try_element_at(col(m), lit(key)), lit(default))


def mget(m, keys) -> Column:
    return F.transform(items(keys), lambda k: F.try_element_at(col(m), k))


def sub_map(m, keys) -> Column:
    return F.map_filter(col(m), lambda k, _: F.array_contains(items(keys), k))


def keys(m) -> Column:
    return F.array_sort(F.map_keys(col(m)))


def values(m) -> Column:
    return F.map_values(col(m))


def sorted_properties(m) -> Column:
    return F.array_sort(F.map_entries(col(m)))


def group_by(structs, key: str) -> Column:
    """Map from a field's value to the structs that have it."""
    a = items(structs)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(a, lambda s: s[key])), lambda v: F.struct(v, F.filter(a, lambda s: s[key] == v))))


def drop_null_values(m) -> Column:
    return F.map_filter(col(m), lambda _, v: v.isNotNull())


def flatten(s, fields: list[str], delimiter: str = ".") -> Column:
    """A nested struct's ``fields`` (dotted paths) as a flat map of strings."""
    return F.create_map(*(x for f in fields for x in (F.lit(f.replace(".", delimiter)), col(s).getField(f) if "." not in f else _path(col(s), f))))


def _path(c: Column, path: str) -> Column:
    for p in path.split("."):
        c = c[p]
    return c.cast("string")
