"""Paths: structs of ``nodes`` (ids) and ``rels`` (types)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col


def nodes(p) -> Column:
    return col(p)["nodes"]


def relationships(p) -> Column:
    return col(p)["rels"]


def length(p) -> Column:
    return F.size(col(p)["rels"])


def start_node(p) -> Column:
    return F.element_at(col(p)["nodes"], 1)


def end_node(p) -> Column:
    return F.element_at(col(p)["nodes"], -1)


def elements(p) -> Column:
    """Nodes and relationships in turn, as texts."""
    a, r = col(p)["nodes"], col(p)["rels"]
    return F.concat(F.flatten(F.zip_with(F.slice(a, F.lit(1), F.size(r)), r, lambda n, t: F.array(n.cast("string"), t))), F.array(F.element_at(a, -1).cast("string")))


def slice_(p, start: int, hops: int) -> Column:
    return F.struct(F.slice(col(p)["nodes"], start + 1, hops + 1).alias("nodes"), F.slice(col(p)["rels"], start + 1, hops).alias("rels"))


def combine(p, q) -> Column:
    """Two paths, the second from where the first ends."""
    a, b = col(p), col(q)
    return F.when(end_node(p) == start_node(q), F.struct(F.concat(a["nodes"], F.slice(b["nodes"], F.lit(2), F.size(b["rels"]))).alias("nodes"), F.concat(a["rels"], b["rels"]).alias("rels")))


def reverse(p) -> Column:
    return F.struct(F.reverse(col(p)["nodes"]).alias("nodes"), F.reverse(col(p)["rels"]).alias("rels"))


def is_simple(p) -> Column:
    return F.size(F.array_distinct(col(p)["nodes"])) == F.size(col(p)["nodes"])
