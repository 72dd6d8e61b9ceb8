"""What changed between two maps, lists or texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import map as _map
from spindrift.functions._base import col, items


def maps(a, b) -> Column:
    """Entries added, removed, changed (old and new) and kept."""
    x, y = col(a), col(b)
    both = F.array_intersect(F.map_keys(x), F.map_keys(y))
    changed = F.filter(both, lambda k: ~F.element_at(x, k).eqNullSafe(F.element_at(y, k)))
    return F.struct(
        F.map_filter(y, lambda k, _: ~F.array_contains(F.map_keys(x), k)).alias("added"),
        F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k)).alias("removed"),
        F.map_from_entries(F.transform(changed, lambda k: F.struct(k, F.struct(F.element_at(x, k).alias("old"), F.element_at(y, k).alias("new"))))).alias("changed"),
        F.map_filter(x, lambda k, v: F.array_contains(both, k) & v.eqNullSafe(F.try_element_at(y, k))).alias("unchanged"))


def nodes(a, b) -> Column:
    """Of two nodes' property maps."""
    return maps(a, b)


def relationships(a, b) -> Column:
    return maps(a, b)


def lists(a, b) -> Column:
    x, y = items(a), items(b)
    return F.struct(F.array_except(y, x).alias("added"), F.array_except(x, y).alias("removed"), F.array_intersect(x, y).alias("common"))


def strings(a, b) -> Column:
    """Lines that only one side has."""
    return lists(F.split(col(a), "\n"), F.split(col(b), "\n"))


def deep(a, b) -> Column:
    return ~F.to_json(F.struct(col(a).alias("v"))).eqNullSafe(F.to_json(F.struct(col(b).alias("v"))))


def patch(m, difference) -> Column:
    """Apply what ``maps`` found."""
    d = col(difference)
    new = F.transform_values(d["changed"], lambda _, v: v["new"])
    return _map.merge(F.map_filter(col(m), lambda k, _: ~F.array_contains(F.map_keys(d["removed"]), k)), d["added"], new)


def merge(a, b, strategy: str = "right") -> Column:
    return _map.merge(a, b) if strategy == "right" else _map.merge(b, a)


def summary(difference) -> Column:
    d = col(difference)
    return F.struct(*(F.size(d[f]).alias(f) for f in ("added", "removed", "changed", "unchanged")))
