"""Writes: each returns another graph; tables change by joins, not in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.graph import Graph
from spindrift.operators.iterate import dealt

#: Nodes of a label that one task takes up.
ROWS_A_TASK = 200_000


def create_nodes(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Append nodes; properties that one side lacks are null there."""
    old = graph.labels.get(label)
    return graph.with_label(label, rows if old is None else old.unionByName(rows, allowMissingColumns=True))


def create_relationships(graph: Graph, type_: str, rows: DataFrame, source: str | None = None, target: str | None = None) -> Graph:
    old = graph.types.get(type_)
    return graph.with_type(type_, rows if old is None else old.table.unionByName(rows, allowMissingColumns=True), source, target)


def merge_nodes(graph: Graph, label: str, rows: DataFrame, keys: list[str], on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> Graph:
    """``MERGE``: rows whose ``keys`` no node has are added (one for each key),
    with ``on_create``; nodes whose keys a row has are changed by ``on_match``."""
    old = graph.labels[label]
    rows = rows.dropDuplicates(keys)
    matched = old
    if on_match:
        hit = rows.select(*keys).withColumn("__hit", F.lit(True))
        matched = old.join(hit, keys, "left")
        for name, value in on_match.items():
            matched = matched.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(name)) if name in old.columns else F.when(F.col("__hit"), value))
        matched = matched.drop("__hit")
    new = rows.join(old.select(*keys), keys, "left_anti")
    for name, value in (on_create or {}).items():
        new = new.withColumn(name, value)
    return graph.with_label(label, matched.unionByName(new, allowMissingColumns=True))


def merge_relationships(graph: Graph, type_: str, rows: DataFrame) -> Graph:
    old = graph.types[type_].table
    new = rows.dropDuplicates(["src", "dst"]).join(old.select("src", "dst"), ["src", "dst"], "left_anti")
    return graph.with_type(type_, old.unionByName(new, allowMissingColumns=True))


def set_properties(graph: Graph, label: str, condition: Column, **values: Column) -> Graph:
    t = graph.labels[label]
    for name, value in values.items():
        t = t.withColumn(name, F.when(condition, value).otherwise(F.col(name) if name in t.columns else F.lit(None)))
    return graph.with_label(label, t)


def remove_properties(graph: Graph, label: str, condition: Column, *names: str) -> Graph:
    return set_properties(graph, label, condition, **{n: F.lit(None) for n in names})


def delete_nodes(graph: Graph, label: str, ids: DataFrame, detach: bool = False) -> Graph:
    """Nodes go; with ``detach`` their relationships too.  Without it,
    relationships that would dangle are an error.  Both sides are dealt by node into
    as many tasks as the label's nodes need."""
    tasks = dealt(graph.labels[label], ROWS_A_TASK)
    gone = ids.select("id").repartition(tasks, "id").distinct()
    out = graph.with_label(label, graph.labels[label].join(gone, "id", "left_anti"))
    for name, r in graph.types.items():
        for end, at in (("src", r.source), ("dst", r.target)):
            if at == label:
                table = out.types[name].table
                if detach:
                    out = out.with_type(name, table.repartition(tasks, end).join(gone.withColumnRenamed("id", end), end, "left_anti").select(*table.columns))
                elif not table.join(gone.withColumnRenamed("id", end), end, "left_semi").isEmpty():
                    raise ValueError(f"nodes still have relationships of type {name}")
    return out


def delete_relationships(graph: Graph, type_: str, pairs: DataFrame) -> Graph:
    table = graph.types[type_].table
    return graph.with_type(type_, table.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*table.columns))


def redirect(graph: Graph, type_: str, moves: DataFrame) -> Graph:
    """Relationship ends moved by ``old``, ``new`` (as when nodes are merged)."""
    table = graph.types[type_].table
    columns = table.columns
    for end in ("src", "dst"):
        m = moves.select(F.col("old").alias(end), F.col("new").alias("__new"))
        table = table.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return graph.with_type(type_, table.select(*columns))
