"""Relationships as structs of ``id``, ``type``, ``src``, ``dst`` and ``properties`` (map of texts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import node as _node
from spindrift.functions._base import col, items, lit


def id_(r) -> Column:
    return col(r)["id"]


def type_(r) -> Column:
    return col(r)["type"]


def properties(r) -> Column:
    return _node.properties(r)


def property_(r, key) -> Column:
    return _node.property_(r, key)


def start_node(r) -> Column:
    return col(r)["src"]


def end_node(r) -> Column:
    return col(r)["dst"]


def nodes(r) -> Column:
    return F.array(start_node(r), end_node(r))


def set_property(r, key, value) -> Column:
    return _node.set_property(r, key, value)


def set_properties(r, more) -> Column:
    return _node.set_properties(r, more)


def remove_property(r, key) -> Column:
    return _node.remove_property(r, key)


def remove_properties(r, keys) -> Column:
    return _node.remove_properties(r, keys)


def to_map(r) -> Column:
    """Texts by field, properties as JSON."""
    fields = [x for f in ("id", "type", "src", "dst") for x in (F.lit(f), col(r)[f].cast("string"))]
    return F.create_map(*fields, F.lit("properties"), F.to_json(properties(r)))


def from_map(m) -> Column:
    """A relationship of what :func:`to_map` gives; ids are texts."""
    m = col(m)
    return F.struct(*(m[f].alias(f) for f in ("id", "type", "src", "dst")), F.from_json(m["properties"], "map<string,string>").alias("properties"))


def exists(r) -> Column:
    return col(r).isNotNull()


def clone(r, new_id) -> Column:
    return _node.clone(r, new_id)


def reverse(r) -> Column:
    return F.struct(id_(r).alias("id"), type_(r).alias("type"), end_node(r).alias("src"), start_node(r).alias("dst"), properties(r).alias("properties"))


def is_type(r, name) -> Column:
    return type_(r) == lit(name)


def is_any_type(r, names) -> Column:
    return F.array_contains(items(names), type_(r))


def has_property(r, key) -> Column:
    return F.map_contains_key(properties(r), lit(key))


def has_properties(r, keys) -> Column:
    """All of them."""
    return F.size(F.array_except(items(keys), F.map_keys(properties(r)))) == 0


def equals(a, b) -> Column:
    """Same id, type, ends and properties."""
    d = _node.diff(a, b)
    same = compare(a, b)["same"]
    return same & (F.size(d["added"]) == 0) & (F.size(d["removed"]) == 0) & (F.size(d["changed"]) == 0)


def compare(a, b) -> Column:
    """Whether id, type and ends are the same, and both types where they differ."""
    same = id_(a).eqNullSafe(id_(b)) & type_(a).eqNullSafe(type_(b)) & start_node(a).eqNullSafe(start_node(b)) & end_node(a).eqNullSafe(end_node(b))
    return F.struct(same.alias("same"), F.when(~type_(a).eqNullSafe(type_(b)), F.struct(type_(a).alias("old"), type_(b).alias("new"))).alias("type"))


def weight(r, key, default: float = 1.0) -> Column:
    """A property as a number; ``default`` where there is none."""
    return F.coalesce(property_(r, key).try_cast("double"), F.lit(float(default)))


def direction(r, node_id) -> Column:
    """``OUTGOING``, ``INCOMING`` or ``NONE``, seen from a node."""
    return F.when(start_node(r) == lit(node_id), "OUTGOING").when(end_node(r) == lit(node_id), "INCOMING").otherwise("NONE")


def other_node(r, node_id) -> Column:
    """The end that isn't the given node; null if neither is."""
    return F.when(start_node(r) == lit(node_id), end_node(r)).when(end_node(r) == lit(node_id), start_node(r))


def is_loop(r) -> Column:
    return start_node(r) == end_node(r)


def is_between(r, a, b) -> Column:
    """In either direction."""
    return is_directed_between(r, a, b) | is_directed_between(r, b, a)


def is_directed_between(r, a, b) -> Column:
    return (start_node(r) == lit(a)) & (end_node(r) == lit(b))
