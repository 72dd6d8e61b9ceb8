"""Connected components as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch

#: Far above the O(log^2 n) rounds that the method needs.
MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return r["n"], r["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Minima are pre-aggregated map-side and joined back, one row a
    vertex.  The edges of a vertex meet in one task: a join with an aggregate isn't
    one that the adaptive skew join splits."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge.

    Returns ``id``, ``component``.  Null ends, self loops and repeated edges are
    ignored; vertices without an edge are absent.
    """
    e = edges.select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b")
    ).where("a is not null and b is not null and u <> v").select("u", "v").distinct()
    scratch = Scratch(edges.sparkSession)
    e = scratch.put(e, "edges0")
    seen = _digest(e)
    for i in range(MAX_ROUNDS):
        e = scratch.put(_star(_star(e, large=True), large=False), f"edges{i + 1}")
        scratch.drop(f"edges{i}")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
