"""Traversals: bounded expansions, shortest paths, path enumeration.

Edges are DataFrames with ``src``, ``dst`` (and ``weight`` where it counts).
Each hop is a join; frontiers are de-duplicated before the next hop and places
that were reached are removed by an anti join, so work follows what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.iterate import settled


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected: every relationship from either end."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


#: Rows of a front that goes to every task, so that the edges stay where they are.
FRONT_ROWS = 200_000


def _front(front: DataFrame) -> DataFrame:
    """A settled front, to be joined with all edges; a small one is broadcast."""
    return F.broadcast(front) if front.count() <= FRONT_ROWS else front


def _seeds(starts: DataFrame) -> DataFrame:
    return starts.select(F.col("id").alias("start"), F.col("id")).distinct()


def neighbors_by_hop(edges: DataFrame, starts: DataFrame, hops: int, stored: bool = False) -> DataFrame:
    """``start``, ``id``, ``hop``: nodes first reached after 1 to ``hops`` hops.

    A hop reads all edges, which are written first unless they are ``stored``."""
    e = edges.select("src", "dst")
    if hops > 1 and not stored:
        e = settled(e, "edges")
    frontier = settled(_seeds(starts), "frontier")
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = e.join(_front(frontier), F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        if hop < hops:
            frontier = settled(frontier, "frontier")
        seen = seen.union(frontier.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def neighbors_to_hop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``start``, ``id`` within ``hops`` hops, the start left out."""
    return neighbors_by_hop(edges, starts, hops).select("start", "id")


def neighbors_at_hop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    return neighbors_by_hop(edges, starts, hops).where(F.col("hop") == hops).select("start", "id")


def var_length(edges: DataFrame, starts: DataFrame, low: int, high: int) -> DataFrame:
    """``start``, ``id``, ``nodes``: every path of ``low`` to ``high`` hops that
    uses no relationship twice."""
    e = edges.select("src", "dst", F.struct("src", "dst").alias("rel"))
    paths = _seeds(starts).withColumn("nodes", F.array("id"))
    out = [paths] if low == 0 else []
    for hop in range(1, high + 1):
        step = paths.join(e, F.col("id") == F.col("src"))
        if hop == 1:
            rels = F.array("rel")
        else:
            step = step.where(~F.array_contains("rels", F.col("rel")))
            rels = F.concat("rels", F.array("rel"))
        paths = step.select("start", F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"), rels.alias("rels"))
        if hop % 3 == 0 and hop < high:
            paths = settled(paths, "paths")
        if hop >= low:
            out.append(paths.drop("rels"))
    found = out[0]
    for p in out[1:]:
        found = found.union(p)
    return found


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, high: int) -> DataFrame:
    """``start``, ``id``, ``nodes``: paths of at most ``high`` hops between two
    sets, no node twice."""
    e = edges.select("src", "dst").distinct()
    goal = ends.select("id").distinct()
    paths = _seeds(starts).withColumn("nodes", F.array("id"))
    found = None
    for hop in range(1, high + 1):
        paths = paths.join(e, F.col("id") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        paths = paths.select("start", F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"))
        if hop < high:
            paths = settled(paths, "paths")
        hit = paths.join(goal, "id", "left_semi").select("start", "id", "nodes")
        found = hit if found is None else found.union(hit)
    return found


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, high: int = 15, every: bool = False, stored: bool = False) -> DataFrame:
    """``start``, ``id``, ``hops``, ``nodes``: a shortest path between each pair
    of the two sets (all of them with ``every``).

    Breadth first with one parent path a node, or all of equal length; among
    equals the one that is first in order.  A start is its own path of 0 hops.  A hop
    reads all edges, which are written first unless they are ``stored``.
    """
    e = edges.select("src", "dst")
    if not stored:
        e = settled(e, "edges")
    paths = settled(_seeds(starts).withColumn("nodes", F.array("id")), "paths")
    seen = paths.select("start", "id")
    levels = [paths.withColumn("hops", F.lit(0))]
    for hop in range(1, high + 1):
        step = e.join(_front(paths), F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"))
        step = step.distinct() if every else step.groupBy("start", "id").agg(F.min("nodes").alias("nodes"))
        step = step.join(seen, ["start", "id"], "left_anti")
        paths = settled(step, "paths")
        if paths.isEmpty():
            break
        seen = seen.union(paths.select("start", "id").distinct())
        levels.append(paths.select("start", "id", "nodes").withColumn("hops", F.lit(hop)))
    found = levels[0]
    for p in levels[1:]:
        found = found.unionByName(p)
    return found.join(ends.select("id").distinct(), "id", "left_semi").select("start", "id", "hops", "nodes")


def weighted_paths(edges: DataFrame, starts: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``start``, ``id``, ``cost``, ``nodes``: cheapest paths from each start
    (relaxation in rounds; ``weight`` must not be negative, null counts as 1).

    Only what became cheaper in a round is extended in the next.
    """
    e = edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    e = settled(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges")
    best = settled(_seeds(starts).select("start", "id", F.lit(0.0).alias("cost"), F.array("id").alias("nodes")), "costs")
    front = best
    for _ in range(most_rounds):
        step = front.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("nodes", F.array("dst")).alias("nodes"))
        step = step.groupBy("start", "id").agg(F.min(F.struct("cost", "nodes")).alias("s")).select("start", "id", "s.cost", "s.nodes")
        old = best.select("start", "id", F.col("cost").alias("old"))
        front = settled(step.join(old, ["start", "id"], "left").where("old is null or cost < old").drop("old"), "front")
        if front.isEmpty():
            return best
        best = settled(best.join(front.select("start", "id"), ["start", "id"], "left_anti").unionByName(front), "costs")
    raise RuntimeError(f"costs still fall after {most_rounds} rounds")


def spanning_tree(edges: DataFrame, starts: DataFrame, high: int = 15) -> DataFrame:
    """``start``, ``id``, ``parent``, ``hops``: one edge into each reached node."""
    p = shortest_paths(edges, starts, edges.select(F.col("dst").alias("id")), high)
    return p.where("hops > 0").select("start", "id", F.element_at("nodes", -2).alias("parent"), "hops")


def subgraph(edges: DataFrame, starts: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of any start (the starts too), and the edges among them."""
    near = neighbors_to_hop(both_ways(edges.select("src", "dst")), starts, hops).select("id").union(starts.select("id")).distinct()
    near = settled(near, "near")
    kept = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return near, kept.select(*edges.columns)


def cycles(edges: DataFrame, high: int) -> DataFrame:
    """``nodes`` of each cycle of at most ``high`` hops, once, from its least node."""
    e = edges.select("src", "dst").distinct()
    paths = e.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.array("src", "dst").alias("nodes"))
    out = e.where("src = dst").select(F.array("src").alias("nodes"))
    for hop in range(2, high + 1):
        step = paths.join(e, F.col("id") == F.col("src")).where("dst >= start")
        out = out.union(step.where("dst = start").select("nodes"))
        if hop < high:
            paths = settled(step.where(~F.array_contains("nodes", F.col("dst"))).select("start", F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes")), "paths")
    return out
