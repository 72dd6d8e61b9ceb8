"""Patterns: chains of joins over a graph's tables.

``match(g, "c", "Customer").out("PLACED", "o", "Order").frame()`` has a struct
column for each named variable; the optimizer removes the fields that nothing reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.graph import Graph


def _packed(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.struct(*table.columns).alias(name))


@dataclass(frozen=True)
class Match:
    """Bindings found so far and the variable that the next hop starts from."""

    graph: Graph
    bound: DataFrame
    at: str

    def frame(self) -> DataFrame:
        return self.bound

    def where(self, condition: Column | str) -> Match:
        return replace(self, bound=self.bound.where(condition))

    def from_(self, variable: str) -> Match:
        """Go on from another bound variable."""
        return replace(self, at=variable)

    def _hop(self, type_: str, to: str, label: str | None, rel: str | None, near: str, far: str, how: str, on: Callable[[DataFrame], DataFrame] | None) -> Match:
        edges = self.graph.types[type_].table
        name = rel or f"__{type_}_{to}"
        side = edges.select(F.col(near).alias("__near"), F.col(far).alias("__far"), F.struct(*edges.columns).alias(name))
        known = to in self.bound.columns  # a cycle closes on a bound variable
        if not known:
            table = self.graph.labels[label]
            table = on(table) if on else table
            side = side.join(table.select(F.col("id").alias("__id"), F.struct(*table.columns).alias(to)), F.col("__far") == F.col("__id")).drop("__id")
        condition = F.col(f"{self.at}.id") == F.col("__near")
        if known:
            condition = condition & (F.col(f"{to}.id") == F.col("__far"))
        out = self.bound.join(side, condition, how).drop("__near", "__far")
        return replace(self, bound=out if rel else out.drop(name), at=to)

    def out(self, type_: str, to: str, label: str | None = None, rel: str | None = None, optional: bool = False, on=None) -> Match:
        """``-[:TYPE]->(to:label)``; ``optional`` keeps bindings without a match
        and ``on`` filters the far nodes before the join."""
        return self._hop(type_, to, label, rel, "src", "dst", "left" if optional else "inner", on)

    def in_(self, type_: str, to: str, label: str | None = None, rel: str | None = None, optional: bool = False, on=None) -> Match:
        """``<-[:TYPE]-(to:label)``."""
        return self._hop(type_, to, label, rel, "dst", "src", "left" if optional else "inner", on)

    def exists(self, type_: str, direction: str = "out", negate: bool = False, far: DataFrame | None = None) -> Match:
        """Bindings that have (or have not) such a relationship: a semi or anti join."""
        edges, near, other = self.graph.types[type_].table, *(("src", "dst") if direction == "out" else ("dst", "src"))
        side = edges.select(F.col(near).alias("__near"), F.col(other).alias("__far"))
        if far is not None:
            side = side.join(far.select(F.col("id").alias("__far")), "__far", "left_semi")
        return replace(self, bound=self.bound.join(side, F.col(f"{self.at}.id") == F.col("__near"), "left_anti" if negate else "left_semi"))

    def count(self, type_: str, name: str, direction: str = "out") -> Match:
        """``COUNT { }``: relationships are counted by node before the join."""
        near = "src" if direction == "out" else "dst"
        counted = self.graph.types[type_].table.groupBy(F.col(near).alias("__near")).agg(F.count("*").alias("__n"))
        out = self.bound.join(counted, F.col(f"{self.at}.id") == F.col("__near"), "left")
        return replace(self, bound=out.withColumn(name, F.coalesce("__n", F.lit(0))).drop("__near", "__n"))

    def and_match(self, other: Match) -> Match:
        """Another pattern, joined on the variables both bind."""
        shared = [c for c in self.bound.columns if c in other.bound.columns]
        if not shared:
            raise ValueError("patterns share no variable; join their frames on a condition instead")
        left, right = self.bound, other.bound
        for c in shared:
            right = right.withColumnRenamed(c, f"__{c}")
        condition = None
        for c in shared:
            same = F.col(f"{c}.id") == F.col(f"__{c}.id")
            condition = same if condition is None else condition & same
        return replace(self, bound=left.join(right, condition).drop(*(f"__{c}" for c in shared)))


def match(graph: Graph, variable: str, label: str, on=None) -> Match:
    """Start a pattern at the nodes of a label."""
    table = graph.labels[label]
    return Match(graph, _packed(on(table) if on else table, variable), variable)


def mutual(graph: Graph, type_: str) -> DataFrame:
    """Pairs ``a`` < ``b`` related both ways: one self join on both ends."""
    e = graph.types[type_].table.select("src", "dst").distinct()
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return e.where("src < dst").join(back, ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def count_by_target(graph: Graph, type_: str, label: str) -> DataFrame:
    """Nodes of a label with how many relationships come in (0 too), counted
    before the join."""
    return graph.labels[label].join(graph.in_degrees(type_), "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def count_by_source(graph: Graph, type_: str, label: str) -> DataFrame:
    return graph.labels[label].join(graph.out_degrees(type_), "id", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))


def aggregate_relationships(graph: Graph, type_: str, end: str, **aggregates: Column) -> DataFrame:
    """Aggregates of relationship properties by the node at one ``end`` (``src``
    or ``dst``), to be joined with nodes afterwards."""
    return graph.types[type_].table.groupBy(F.col(end).alias("id")).agg(*(a.alias(n) for n, a in aggregates.items()))


def unwind(df: DataFrame, xs: Column | str, name: str) -> DataFrame:
    """A row for each item; none for null or empty lists."""
    return df.withColumn(name, F.explode(xs))
