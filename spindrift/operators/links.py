"""Link prediction: scores of pairs that are not linked yet.

Pairs come from two-hop joins over neighbours; a neighbour of very high degree
gives pairs as the square of its degree.  None is left out; ``sources`` bounds
the pairs where only those of some nodes are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.traverse import both_ways


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected: ``src``, ``dst`` both ways, no loops, with ``deg`` of ``dst``."""
    e = both_ways(edges.select("src", "dst")).where("src <> dst").distinct()
    return e.join(e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("deg")), "dst")


def scores(edges: DataFrame, sources: DataFrame | None = None, linked_too: bool = False) -> DataFrame:
    """``a``, ``b``, ``common_neighbors``, ``adamic_adar``, ``resource_allocation``,
    ``jaccard``, ``preferential_attachment`` for pairs ``a <> b`` with a common
    neighbour; ``sources`` (``id``) limits ``a``."""
    e = neighbours(edges)
    left = e if sources is None else e.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    two = left.select(F.col("src").alias("a"), F.col("dst").alias("via"), "deg").join(e.select(F.col("src").alias("via"), F.col("dst").alias("b")), "via").where("a <> b")
    pair = two.groupBy("a", "b").agg(
        F.count("*").alias("common_neighbors"),
        F.sum(F.when(F.col("deg") > 1, 1 / F.ln("deg")).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / F.col("deg")).alias("resource_allocation"))
    if not linked_too:
        pair = pair.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    d = e.groupBy(F.col("dst").alias("id")).agg(F.first("deg").alias("d"))
    pair = pair.join(d.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    return pair.select("a", "b", "common_neighbors", "adamic_adar", "resource_allocation",
                       (F.col("common_neighbors") / (F.col("da") + F.col("db") - F.col("common_neighbors"))).alias("jaccard"), (F.col("da") * F.col("db")).alias("preferential_attachment"))


def preferential_attachment(edges: DataFrame, source: DataFrame) -> DataFrame:
    """``a``, ``b``, ``score`` of each given node with all nodes that it is not
    linked with (``source`` is a stated query set)."""
    e = neighbours(edges)
    d = e.groupBy(F.col("dst").alias("id")).agg(F.first("deg").alias("d"))
    a = d.join(source.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("d").alias("da"))
    pairs = a.join(d.select(F.col("id").alias("b"), F.col("d").alias("db")), F.col("a") != F.col("b"))
    return pairs.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti").select("a", "b", (F.col("da") * F.col("db")).alias("score"))


def predict(edges: DataFrame, similarity: DataFrame, topology: float = 0.5, least: float = 0.3) -> DataFrame:
    """``a``, ``b``, ``score``: a blend of normalised common neighbours and the
    ``similarity`` (0 to 1) of ``a``, ``b``."""
    t = scores(edges).select("a", "b", (F.col("common_neighbors") / (1 + F.col("common_neighbors"))).alias("t"))
    both = t.join(similarity.select("a", "b", "similarity"), ["a", "b"], "full_outer")
    return both.select("a", "b", (topology * F.coalesce("t", F.lit(0.0)) + (1 - topology) * F.coalesce("similarity", F.lit(0.0))).alias("score")).where(F.col("score") >= least)
