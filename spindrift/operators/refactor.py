"""Changes of a graph's shape: each returns other tables or another graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.graph import Graph
from spindrift.operators import writes
from spindrift.operators.iterate import dealt

#: Relationships that one task takes up.
ROWS_A_TASK = 400_000


def merge_relationships(rels: DataFrame, order: str) -> DataFrame:
    """One for each pair of ends: of each property the first value by ``order``
    that isn't null, the least of those at one place."""
    values = [c for c in rels.columns if c not in ("src", "dst", order)]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c)
    return rels.groupBy("src", "dst").agg(F.min(order).alias(order), *map(first, values))


def clone_nodes(graph: Graph, label: str, new_id: Column, condition: Column | None = None) -> Graph:
    """Nodes once more under another id."""
    t = graph.labels[label]
    some = t if condition is None else t.where(condition)
    return writes.create_nodes(graph, label, some.withColumn("id", new_id))


def bypasses(incoming: DataFrame, outgoing: DataFrame, ids: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``via``: what leads into a node of ``ids`` joined with
    what leads out.  The result has a row for each way through a node.  All are dealt
    by that node into as many tasks as what leads in and out needs."""
    tasks = dealt(incoming, ROWS_A_TASK) + dealt(outgoing, ROWS_A_TASK)
    gone = ids.select(F.col("id").alias("via")).repartition(tasks, "via").distinct()
    into = incoming.select("src", F.col("dst").alias("via")).repartition(tasks, "via").join(gone, "via", "left_semi")
    return into.join(outgoing.select(F.col("src").alias("via"), "dst").repartition(tasks, "via"), "via").select("src", "dst", "via")


def collapse_nodes(graph: Graph, label: str, ids: DataFrame, into: str, out: str, type_: str) -> Graph:
    """Relationships ``type_`` past nodes of ``label``, which stay."""
    a, b = graph.types[into], graph.types[out]
    return writes.create_relationships(graph, type_, bypasses(a.table, b.table, ids).select("src", "dst"), a.source, b.target)


def delete_and_reconnect(graph: Graph, label: str, ids: DataFrame, into: str, out: str, type_: str) -> Graph:
    """As :func:`collapse_nodes`, and the nodes go with their relationships."""
    return writes.delete_nodes(collapse_nodes(graph, label, ids, into, out, type_), label, ids, detach=True)


def extract_nodes(graph: Graph, type_: str, label: str, new_id: Column, first: str, second: str) -> Graph:
    """Each relationship as a node with its properties, between two relationships
    ``first`` and ``second``."""
    r = graph.types[type_]
    t = r.table.withColumn("id", new_id)
    graph = graph.with_label(label, t.drop("src", "dst"))
    graph = graph.with_type(first, t.select("src", F.col("id").alias("dst")), r.source, label).with_type(second, t.select(F.col("id").alias("src"), "dst"), label, r.target)
    return replace(graph, types={k: v for k, v in graph.types.items() if k != type_})


def invert(graph: Graph, type_: str) -> Graph:
    r = graph.types[type_]
    rest = [c for c in r.table.columns if c not in ("src", "dst")]
    table = r.table.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return replace(graph, types=graph.types | {type_: replace(r, table=table, source=r.target, target=r.source)})


def rename_label(graph: Graph, old: str, new: str) -> Graph:
    end = lambda x: new if x == old else x
    types = {k: replace(r, source=end(r.source), target=end(r.target)) for k, r in graph.types.items()}
    return replace(graph, labels={end(k): t for k, t in graph.labels.items()}, types=types)


def rename_type(graph: Graph, old: str, new: str) -> Graph:
    return replace(graph, types={new if k == old else k: r for k, r in graph.types.items()})


def rename_property(graph: Graph, label: str, old: str, new: str) -> Graph:
    return graph.with_label(label, graph.labels[label].withColumnRenamed(old, new))


def change_type(graph: Graph, type_: str, condition: Column, new: str) -> Graph:
    """Relationships for which ``condition`` is true get another type."""
    r, hit = graph.types[type_], F.coalesce(condition, F.lit(False))
    graph = writes.create_relationships(graph, new, r.table.where(hit), r.source, r.target)
    return graph.with_type(type_, r.table.where(~hit))


def categorized(x: Column, categories: Sequence[tuple[float, float, str]]) -> Column:
    """The name of the first range ``low <= x < high``; null outside all."""
    found = F.lit(None).cast("string")
    for low, high, name in reversed(categories):
        found = F.when((x >= low) & (x < high), name).otherwise(found)
    return found


def as_boolean(x: Column, true_values: Sequence[str], false_values: Sequence[str]) -> Column:
    """True or false by lists of texts; null otherwise."""
    return F.when(x.isin(list(true_values)), True).when(x.isin(list(false_values)), False)


def category_nodes(nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The values of a property as nodes (``id``), and relationships to them."""
    rels = nodes.where(F.col(key).isNotNull()).select(F.col("id").alias("src"), F.col(key).alias("dst"))
    return rels.select(F.col("dst").alias("id")).distinct(), rels
