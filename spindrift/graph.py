"""Property graphs as catalogues of DataFrames.

A graph holds one DataFrame for each node label (column ``id`` and properties)
and one for each relationship type (``src``, ``dst`` and properties).  Tables
are typed and lazy, so column pruning, predicate pushdown and partition pruning
reach the files under them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relationships:
    """A relationship table and the labels at its ends (None: any)."""

    table: DataFrame
    source: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class Graph:
    """An immutable graph; writes return another graph."""

    spark: SparkSession
    labels: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, Relationships] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    constraints: dict[str, dict] = field(default_factory=dict)

    # Scans -----------------------------------------------------------------

    def nodes(self, label: str | None = None) -> DataFrame:
        """Nodes of a label, or ``id`` and ``label`` of all."""
        if label is not None:
            return self.labels[label]
        return reduce(DataFrame.unionByName, (t.select(F.col("id").cast("string").alias("id"), F.lit(name).alias("label")) for name, t in self.labels.items()))

    def rels(self, *types: str) -> DataFrame:
        """Relationships of one type, or ``src``, ``dst``, ``type`` of several (all if none is named)."""
        if len(types) == 1:
            return self.types[types[0]].table
        chosen = types or tuple(self.types)
        return reduce(DataFrame.unionByName, (self.types[t].table.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(t).alias("type")) for t in chosen))

    def node(self, label: str, id_) -> DataFrame:
        return self.labels[label].where(F.col("id") == id_)

    def first(self, label: str) -> DataFrame:
        return self.labels[label].limit(1)

    def nodes_by_id(self, label: str, ids: DataFrame) -> DataFrame:
        """Nodes whose ``id`` is among ``ids``, a table of any size."""
        return self.labels[label].join(ids.select("id").distinct(), "id", "left_semi")

    def between(self, type_: str, src, dst) -> DataFrame:
        return self.types[type_].table.where((F.col("src") == src) & (F.col("dst") == dst))

    def where(self, label: str, **values) -> DataFrame:
        """Nodes with the given property values (pushed down to the files)."""
        return reduce(lambda t, kv: t.where(F.col(kv[0]) == kv[1]), values.items(), self.labels[label])

    def range(self, label: str, key: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> DataFrame:
        t = self.labels[label]
        if low is not None:
            t = t.where(F.col(key) >= low if include_low else F.col(key) > low)
        if high is not None:
            t = t.where(F.col(key) <= high if include_high else F.col(key) < high)
        return t

    # Degrees and counts ----------------------------------------------------

    def out_degrees(self, type_: str) -> DataFrame:
        return self.types[type_].table.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))

    def in_degrees(self, type_: str) -> DataFrame:
        return self.types[type_].table.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))

    def counts(self) -> DataFrame:
        """``kind``, ``name``, ``n`` for every label and type."""
        parts = [t.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(n).alias("name"), "n") for n, t in self.labels.items()]
        parts += [r.table.agg(F.count("*").alias("n")).select(F.lit("relationship").alias("kind"), F.lit(n).alias("name"), "n") for n, r in self.types.items()]
        return reduce(DataFrame.union, parts)

    # Schema ----------------------------------------------------------------

    def schema(self) -> DataFrame:
        """``source``, ``type``, ``target`` of every relationship type."""
        return self.spark.createDataFrame([(r.source, t, r.target) for t, r in self.types.items()], "source string, type string, target string")

    def properties(self) -> DataFrame:
        """``kind``, ``name``, ``property``, ``type`` of every column."""
        rows = [("node", n, f.name, f.dataType.simpleString()) for n, t in self.labels.items() for f in t.schema.fields]
        rows += [("relationship", n, f.name, f.dataType.simpleString()) for n, r in self.types.items() for f in r.table.schema.fields]
        return self.spark.createDataFrame(rows, "kind string, name string, property string, type string")

    def show_indexes(self) -> DataFrame:
        return self.spark.createDataFrame([(n, i["kind"], i["label"], i["properties"]) for n, i in self.indexes.items()], "name string, kind string, label string, properties array<string>")

    def show_constraints(self) -> DataFrame:
        return self.spark.createDataFrame([(n, c["kind"], c["label"], c["properties"]) for n, c in self.constraints.items()], "name string, kind string, label string, properties array<string>")

    def with_index(self, name: str, kind: str, label: str, properties: Iterable[str]) -> Graph:
        """A named index: the layout (``sources.layout``) or derived table
        (``operators.search``) that serves it is made when it is used."""
        return replace(self, indexes=self.indexes | {name: {"kind": kind, "label": label, "properties": list(properties)}})

    def with_constraint(self, name: str, kind: str, label: str, properties: Iterable[str]) -> Graph:
        return replace(self, constraints=self.constraints | {name: {"kind": kind, "label": label, "properties": list(properties)}})

    def without(self, name: str) -> Graph:
        """Without an index or constraint."""
        drop = lambda d: {k: v for k, v in d.items() if k != name}
        return replace(self, indexes=drop(self.indexes), constraints=drop(self.constraints))

    def with_label(self, label: str, table: DataFrame) -> Graph:
        return replace(self, labels=self.labels | {label: table})

    def with_type(self, type_: str, table: DataFrame, source: str | None = None, target: str | None = None) -> Graph:
        old = self.types.get(type_)
        return replace(self, types=self.types | {type_: Relationships(table, source or (old and old.source), target or (old and old.target))})

    def violations(self, name: str) -> DataFrame:
        """Rows that break a constraint: property values and how many nodes have them.

        ``unique``: a value of several nodes; ``exists``: nodes without one; ``key``: both.
        """
        c = self.constraints[name]
        keys, t = c["properties"], self.labels[c["label"]]
        absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        missing = t.where(absent).groupBy(*keys).agg(F.count("*").alias("n"))
        repeated = t.where(~absent).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return {"unique": repeated, "exists": missing, "key": repeated.union(missing)}[c["kind"]]
