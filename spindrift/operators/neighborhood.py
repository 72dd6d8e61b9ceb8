"""What lies around nodes, for all nodes at once.

``rels`` has ``src``, ``dst`` and ``type``.  A direction is ``out``, ``in`` or
``both``.  Degrees and types are summed before they are shuffled, so a hub costs
a row for each task and not one for each of its relationships.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.iterate import dealt

#: Relationships that one task takes up.
ROWS_A_TASK = 400_000


def relationships(rels: DataFrame, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """``id``, ``other``, ``type``: each relationship seen from its ends; a loop
    counts once for each end."""
    if types:
        rels = rels.where(F.col("type").isin(list(types)))
    out = rels.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type")
    back = rels.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type")
    return {"out": out, "in": back}.get(direction) or out.unionAll(back)


def relationship_types(rels: DataFrame, direction: str = "both") -> DataFrame:
    """``id``, ``types``: sorted names, of which there are few."""
    return relationships(rels, direction).groupBy("id").agg(F.array_sort(F.collect_set("type")).alias("types"))


def neighbors(rels: DataFrame, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """``id``, ``other``: each neighbour once."""
    return relationships(rels, direction, types).select("id", "other").distinct()


def relationship_exists(nodes: DataFrame, rels: DataFrame, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """All nodes with ``exists``: whether they have such a relationship."""
    some = relationships(rels, direction, types).select("id").distinct().withColumn("exists", F.lit(True))
    return nodes.join(some, "id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def connected(pairs: DataFrame, rels: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Pairs ``a``, ``b`` with ``connected``: whether one relationship joins them, either way.

    Relationships are dealt by their ends into as many tasks as they need, and only
    those between ends that were asked for are gathered."""
    some = rels.where(F.col("type").isin(list(types))) if types else rels
    tasks = dealt(rels, ROWS_A_TASK)
    ends = lambda df, a, b: df.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).repartition(tasks, "low", "high")
    seen = ends(some, "src", "dst").join(ends(pairs, "a", "b"), ["low", "high"], "left_semi").distinct()
    seen = seen.select("low", "high", F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")), F.struct(F.col("high").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").distinct().withColumn("connected", F.lit(True))
    return pairs.join(seen, ["a", "b"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


def summaries(rels: DataFrame, threshold: int) -> DataFrame:
    """``id``, ``types``, ``types_out``, ``types_in`` (null without any that way), ``neighbors`` (how
    many there are) and ``dense`` (the degree, if over ``threshold``), for nodes with relationships.

    Each relationship is dealt to its ends once: a row for a node and neighbour,
    which are then summed where they are."""
    tasks = dealt(rels, ROWS_A_TASK)
    out = relationships(rels, "out").withColumn("out", F.lit(True))
    ends = out.unionAll(relationships(rels, "in").withColumn("out", F.lit(False))).repartition(tasks, "id")
    way = lambda out: F.collect_set(F.when(F.col("out") == out, F.col("type")))
    near = ends.groupBy("id", "other").agg(way(True).alias("o"), way(False).alias("i"), F.count("*").alias("n"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    each = near.groupBy("id").agg(flat("o").alias("o"), flat("i").alias("i"), F.count("other").alias("neighbors"), F.sum("n").alias("degree"))
    some = lambda c: F.when(F.col("id").isNotNull() & (F.size(c) > 0), F.array_sort(c))
    return each.select("id", F.array_sort(F.array_union("o", "i")).alias("types"), some("o").alias("types_out"), some("i").alias("types_in"), "neighbors",
                       F.when(F.col("degree") > threshold, F.col("degree")).alias("dense"))


def dense(rels: DataFrame, threshold: int) -> DataFrame:
    """``id``, ``degree`` of nodes with more relationships than ``threshold``."""
    return relationships(rels).groupBy("id").agg(F.count("*").alias("degree")).where(F.col("degree") > threshold)


# Sets of nodes: tables with ``id``.


def among(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Relationships with both ends in the set."""
    ids = nodes.select("id").distinct()
    return rels.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*rels.columns)


def density(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """``n`` nodes, ``linked`` pairs of them and their ``density``: the share of
    all pairs (null for less than two nodes)."""
    pairs = among(nodes, rels).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n, linked = nodes.agg(F.countDistinct("id").alias("n")), pairs.agg(F.count("*").alias("linked"))
    share = F.try_divide(2.0 * F.col("linked"), F.col("n") * (F.col("n") - 1))
    return n.crossJoin(F.broadcast(linked)).withColumn("density", share)  # one row each


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def grouped(nodes: DataFrame, key: str) -> DataFrame:
    """``value``, ``n``, ``first`` (least id) by a property; null for those without it."""
    return nodes.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def collapsed(nodes: DataFrame, group: str, order: str, type_: str) -> DataFrame:
    """Each group's chain of nodes as one relationship from its first to its last
    by ``order``, ties by id.  ``between`` counts the nodes on the way; groups of
    one node have none."""
    at = F.struct(order, "id")
    ends = nodes.groupBy(group).agg(F.min_by("id", at).alias("src"), F.max_by("id", at).alias("dst"), F.count("*").alias("n"))
    return ends.where("n > 1").select(group, "src", F.lit(type_).alias("type"), "dst", (F.col("n") - 2).alias("between"))
