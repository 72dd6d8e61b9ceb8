"""Communities by the map equation, by greedy modularity and by short random walks.

``nodes`` has ``id``; ``edges`` has ``src``, ``dst`` and perhaps ``weight`` (positive,
null counts as 1), taken both ways; loops are left out and parallel edges add up.
Nodes without edges are communities of their own.  In a round many merges or
moves happen at once, chosen so that none stands in the way of another; what a
round leaves is written to the shared folder.  ``community`` is the least id inside.

A community never leaves its connected component.  So unless one is large, all tables
are bucketed by component (``home``, the first of ``keys``), and rounds shuffle no rows; of
the map equation, all rounds of such components are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.algorithms import components
from spindrift.operators.iterate import bucketed_tables, dealt, settled

#: Edges (both ways) of a component that may stay in one bucket, and of a bucket.
EDGES_TOGETHER, EDGES_A_BUCKET = 10_000, 500_000

#: Changes below this are rounding.
LEAST_GAIN = 1e-10


def _weights(edges: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``w``, both ways."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).where("src <> dst")
    return settled(e.union(e.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "weights")


@contextmanager
def _by_component(ids: DataFrame, e: DataFrame):
    """``keys``, ``keep`` and ``homed(df, end)``.  With small components only, ``keys`` is
    ``home``, which ``homed`` adds by a column of nodes, and ``keep`` writes buckets by it;
    else there is none, and each join deals its rows anew."""
    parts = settled(components(ids, e).withColumnRenamed("component", "home"), "homes")
    at = lambda end: parts.withColumnRenamed("id", end)
    if e.join(at("src"), "src").groupBy("home").count().where(F.col("count") > EDGES_TOGETHER).isEmpty():
        buckets = dealt(e, EDGES_A_BUCKET)
        with bucketed_tables(e.sparkSession, "home", buckets) as keep:
            yield ["home"], keep, lambda df, end: keep(df.join(at(end), end).select("home", *df.columns).repartition(buckets, "home"))
    else:
        yield [], settled, lambda df, end: df


def _named(part: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Communities by their least member."""
    least = part.groupBy(*keys, "community").agg(F.min("id").alias("least"))
    return settled(part.join(least, [*keys, "community"]).select("id", F.col("least").alias("community")), "parts")


def _merged(part: DataFrame, went: list[DataFrame], keys: Sequence[str], keep) -> DataFrame:
    """``part`` after all rounds in which communities ``b`` became ``a``."""
    for i, merges in enumerate(went):
        to = merges.select(*keys, F.col("b").alias("community"), F.col("a").alias("to"))
        part = part.join(to, [*keys, "community"], "left").select(*keys, "id", F.coalesce("to", "community").alias("community"))
        if i % 8 == 7:
            part = keep(part)
    return part


def _contracted(between: DataFrame, merges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights between communities after the merges."""
    renamed = lambda end: merges.select(*keys, F.col("b").alias(end), F.col("a").alias(f"{end}_to"))
    e = between.join(renamed("src"), [*keys, "src"], "left").join(renamed("dst"), [*keys, "dst"], "left")
    e = e.select(*keys, F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), "w").where("src <> dst")
    return e.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))


def _mutual(scored: DataFrame, best_first: Column, keys: Sequence[str]) -> DataFrame:
    """Of pairs ``src`` < ``dst`` those that are best for both ends.  Order is total, so
    the best pair of all is one of them."""
    order = F.struct(best_first.alias("o"), F.col("src").alias("x"), F.col("dst").alias("y"))
    ends = scored.select(*keys, F.explode(F.array("src", "dst")).alias("at"), order.alias("o"))
    chosen = ends.groupBy(*keys, "at").agg(F.min("o").alias("o")).groupBy(*keys, "o").agg(F.count("*").alias("n")).where("n = 2")
    return chosen.select(*keys, F.col("o.x").alias("a"), F.col("o.y").alias("b"))


def fast_greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``community`` by merging for the greatest gain of modularity.

    From single nodes, pairs of communities that are each other's best merge, all
    in one round, while a merge gains.  A hub takes one neighbour a round.
    """
    e = _weights(edges)
    total = e.agg(F.sum("w")).first()[0]
    ids = settled(nodes.select("id").distinct(), "ids")
    if not total:
        return ids.withColumn("community", F.col("id"))
    with _by_component(ids, e) as (keys, keep, homed):
        between, part, went = homed(e, "src"), homed(ids, "id").withColumn("community", F.col("id")), []
        degree = keep(between.groupBy(*keys, F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        while True:
            k = lambda end: degree.select(*keys, F.col("id").alias(end), F.col("k").alias(f"k_{end}"))
            gains = between.where("src < dst").join(k("src"), [*keys, "src"]).join(k("dst"), [*keys, "dst"])
            gains = gains.withColumn("gain", F.round(2 * (F.col("w") / total - F.col("k_src") * F.col("k_dst") / (total * total)), 12)).where(F.col("gain") > LEAST_GAIN)
            merges = keep(_mutual(gains, -F.col("gain"), keys))
            if merges.isEmpty():
                return _named(_merged(part, went, keys, keep), keys)
            went.append(merges)
            between = keep(_contracted(between, merges, keys))
            to = merges.select(*keys, F.col("b").alias("id"), "a")
            degree = keep(degree.join(to, [*keys, "id"], "left").groupBy(*keys, F.coalesce("a", "id").alias("id")).agg(F.sum("k").alias("k")))


def walk_trap(nodes: DataFrame, edges: DataFrame, steps: int = 4) -> DataFrame:
    """``id``, ``community`` by how alike the walks of ``steps`` steps from nodes end.

    Walks may stay: a node has a loop as heavy as its mean edge.  A merge of
    neighbours costs what it adds to the squared distances of walks to their
    community's mean; pairs that are each other's cheapest merge, in rounds, until
    no neighbours are left, and the round with the best modularity counts.  A node
    has a row for each node that it reaches in ``steps`` steps.
    """
    e = _weights(edges)
    ids = settled(nodes.select("id").distinct(), "ids")
    if e.isEmpty():
        return ids.withColumn("community", F.col("id"))
    with _by_component(ids, e) as (keys, keep, homed):
        between, part, went = homed(e, "src"), homed(ids, "id").withColumn("community", F.col("id")), []
        loops = between.groupBy(*keys, "src").agg(F.sum("w").alias("s"), F.avg("w").alias("mean"))
        reach = keep(loops.select(*keys, "src", (F.col("s") + F.col("mean")).alias("d"), "mean", "s"))
        # What a node gives to each neighbour, and what it keeps.
        step = between.join(reach, [*keys, "src"]).select(*keys, F.col("src").alias("k"), "dst", (F.col("w") / F.col("d")).alias("share"))
        step = keep(step.groupBy(*keys, "k").agg(F.collect_list(F.struct("dst", "share")).alias("to")))
        stays = reach.select(*keys, F.col("src").alias("k"), (F.col("mean") / F.col("d")).alias("share"))
        step = step.join(stays, [*keys, "k"]).select(*keys, "k", F.explode(F.concat("to", F.array(F.struct(F.col("k").alias("dst"), "share")))).alias("t")).select(*keys, "k", "t.dst", "t.share")
        walks = reach.select(*keys, F.col("src").alias("c"), F.col("src").alias("k"), F.lit(1.0).alias("p"))
        for _ in range(steps):
            walks = keep(walks.join(step, [*keys, "k"]).groupBy(*keys, "c", F.col("dst").alias("k")).agg(F.sum(F.col("p") * F.col("share")).alias("p")))
        # Distances are plain ones of these coordinates.
        walks = keep(walks.join(reach.select(*keys, F.col("src").alias("k"), "d"), [*keys, "k"]).select(*keys, "c", "k", (F.col("p") / F.sqrt("d")).alias("p")))
        sizes = keep(reach.select(*keys, F.col("src").alias("c"), F.lit(1).cast("long").alias("n"), F.col("s").alias("strength"), F.lit(0.0).alias("inside")))
        total = sizes.agg(F.sum("strength")).first()[0]
        quality = lambda: sizes.agg(F.sum(F.col("inside") / total - F.pow(F.col("strength") / total, 2))).first()[0]
        best, best_round = quality(), 0
        while True:
            pairs = between.where("src < dst").select(*keys, "src", "dst")
            norms = walks.groupBy(*keys, "c").agg(F.sum(F.col("p") * F.col("p")).alias("norm"))
            both = pairs.join(walks.select(*keys, F.col("c").alias("src"), "k", F.col("p").alias("p1")), [*keys, "src"]).join(walks.select(*keys, F.col("c").alias("dst"), "k", F.col("p").alias("p2")), [*keys, "dst", "k"])
            cross = both.groupBy(*keys, "src", "dst").agg(F.sum(F.col("p1") * F.col("p2")).alias("cross"))
            side = lambda end: sizes.join(norms, [*keys, "c"]).select(*keys, F.col("c").alias(end), F.col("n").alias(f"n_{end}"), F.col("norm").alias(f"norm_{end}"))
            costs = pairs.join(cross, [*keys, "src", "dst"], "left").join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])
            apart = F.greatest(F.col("norm_src") + F.col("norm_dst") - 2 * F.coalesce("cross", F.lit(0.0)), F.lit(0.0))
            costs = costs.withColumn("cost", F.round(F.col("n_src") * F.col("n_dst") / (F.col("n_src") + F.col("n_dst")) * apart, 12))
            merges = keep(_mutual(costs, F.col("cost"), keys))
            if merges.isEmpty():
                return _named(_merged(part, went[:best_round], keys, keep), keys)
            went.append(merges)
            to = merges.select(*keys, F.col("b").alias("c"), "a")
            inner = merges.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))
            gained = between.join(inner, [*keys, "src", "dst"]).select(*keys, F.col("src").alias("c"), (2 * F.col("w")).alias("more"))
            weighed = walks.join(sizes.select(*keys, "c", "n"), [*keys, "c"]).join(to, [*keys, "c"], "left").groupBy(*keys, F.coalesce("a", "c").alias("c"), "k").agg(F.sum(F.col("p") * F.col("n")).alias("p"))
            sizes = keep(sizes.join(to, [*keys, "c"], "left").groupBy(*keys, F.coalesce("a", "c").alias("c")).agg(*(F.sum(x).alias(x) for x in ("n", "strength", "inside")))
                         .join(gained, [*keys, "c"], "left").withColumn("inside", F.col("inside") + F.coalesce("more", F.lit(0.0))).drop("more"))
            walks = keep(weighed.join(sizes.select(*keys, "c", "n"), [*keys, "c"]).select(*keys, "c", "k", (F.col("p") / F.col("n")).alias("p")))
            between = keep(_contracted(between, merges, keys))
            now = quality()
            if now > best + LEAST_GAIN:
                best, best_round = now, len(went)


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _modules(units: DataFrame, flows: DataFrame, part: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``m``, ``p``, ``q``: of each module the visits and the exits."""
    inside = part.join(units, [*keys, "id"]).groupBy(*keys, F.col("module").alias("m")).agg(F.sum("p").alias("p"))
    at = lambda end, m: part.select(*keys, F.col("id").alias(end), F.col("module").alias(m))
    ends = flows.join(at("src", "m"), [*keys, "src"]).join(at("dst", "other"), [*keys, "dst"])
    leaving = ends.where("m <> other").groupBy(*keys, "m").agg(F.sum("f").alias("q"))
    return inside.join(leaving, [*keys, "m"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))


def _length(modules: DataFrame) -> tuple[float, float]:
    """Bits a step that modules cost, without the constant part of the nodes, and the
    sum of their exits."""
    r = modules.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("all"), F.sum(_plogp(F.col("q") + F.col("p")) - 2 * _plogp(F.col("q"))).alias("own"))
    return tuple(r.select(_plogp(F.col("all")) + F.coalesce("own", F.lit(0.0)), "all").first())


def _moved(units: DataFrame, flows: DataFrame, most_rounds: int, tolerance: float, lengths: list[float], keys: Sequence[str], keep) -> DataFrame:
    """``keys``, ``id``, ``module``: units after moves that shorten the description, while a round
    does so by ``tolerance``."""
    units = keep(units.join(flows.groupBy(*keys, F.col("src").alias("id")).agg(F.sum("f").alias("f")), [*keys, "id"], "left").withColumn("f", F.coalesce("f", F.lit(0.0))))
    part = units.select(*keys, "id", F.col("id").alias("module"))
    modules = keep(_modules(units, flows, part, keys))
    now, all_q = _length(modules)
    lengths.append(now)
    for round_ in range(most_rounds):
        to = flows.join(part.select(*keys, F.col("id").alias("dst"), F.col("module").alias("b")), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id"), "b").agg(F.sum("f").alias("fb"))
        moves = to.join(part.join(units, [*keys, "id"]).withColumnRenamed("module", "a"), [*keys, "id"])
        moves = moves.withColumn("fa", F.coalesce(F.max(F.when(F.col("a") == F.col("b"), F.col("fb"))).over(Window.partitionBy(*keys, "id")), F.lit(0.0))).where("a <> b")
        at = lambda x: modules.select(*keys, F.col("m").alias(x), F.col("p").alias(f"p{x}"), F.col("q").alias(f"q{x}"))
        moves = moves.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"])
        c = F.col
        qa, qb = F.greatest(c("qa") - c("f") + 2 * c("fa"), F.lit(0.0)), F.greatest(c("qb") + c("f") - 2 * c("fb"), F.lit(0.0))
        change = _plogp(F.lit(all_q) + qa - c("qa") + qb - c("qb")) - _plogp(F.lit(all_q)) - 2 * (_plogp(qa) + _plogp(qb) - _plogp(c("qa")) - _plogp(c("qb")))
        change = change + _plogp(qa + F.greatest(c("pa") - c("p"), F.lit(0.0))) + _plogp(qb + c("pb") + c("p")) - _plogp(c("qa") + c("pa")) - _plogp(c("qb") + c("pb"))
        # In a round a module either gives or takes, so that no two change places.
        gives = lambda m: F.pmod(F.xxhash64(m, F.lit(round_)), F.lit(2)) == 0
        moves = moves.withColumn("change", F.round(change, 12)).where(F.col("change") < -LEAST_GAIN).withColumn("may", gives(c("a")) & ~gives(c("b")))
        best = keep(moves.where("may").groupBy(*keys, "id").agg(F.min(F.struct("change", "b")).alias("s")).select(*keys, "id", "s.change", F.col("s.b").alias("to")))
        n = best.count()
        if not n:
            if moves.isEmpty():
                break
            continue
        # All moves, or else fewer, and at last the one that shortens most.
        share = 1
        while True:
            some = best.orderBy("change", "id").limit(1) if share >= n else best.where(F.pmod(F.xxhash64("id", F.lit(round_ + 1)), F.lit(share)) == 0)
            tried = keep(part.join(some.select(*keys, "id", "to"), [*keys, "id"], "left").select(*keys, "id", F.coalesce("to", "module").alias("module")))
            sums = keep(_modules(units, flows, tried, keys))
            new, new_q = _length(sums)
            if new < now - LEAST_GAIN / 10:
                gain = now - new
                part, modules, now, all_q = tried, sums, new, new_q
                lengths.append(now)
                break
            if share >= n:
                return part
            share *= 4
        if share == 1 and gain < tolerance:
            break
    return part


def info_map(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100, tolerance: float = 1e-2, lengths: list[float] | None = None) -> DataFrame:
    """``id``, ``community`` by the two-level map equation over undirected flow.

    A walk visits a node in proportion to its weight.  Nodes move to the
    neighbouring module that shortens the description of the walk most, then
    modules move as wholes, level upon level, until a level shortens it by less than
    ``tolerance`` bits.  A round is taken only if the description did get shorter, and
    is a level's last if by less than that; ``lengths``, if given, gets the bits a step after each,
    without the constant of the nodes.

    Components that are small share only the sum of all exits.  A job finds the modules of
    each for a sum that is given, and some jobs the sum at which as many are found; of their
    results that of the shortest description counts.
    """
    lengths = [] if lengths is None else lengths
    w = _weights(edges)
    total = w.agg(F.sum("w")).first()[0]
    ids = settled(nodes.select("id").distinct(), "ids")
    if not total:
        return ids.withColumn("community", F.col("id"))
    with _by_component(ids, w) as (keys, keep, homed):
        if keys:
            return _apart(ids, homed(w, "src").select("home", "src", "dst", (F.col("w") / total).alias("f")), most_rounds, lengths)
        flows, part = homed(w, "src").select(*keys, "src", "dst", (F.col("w") / total).alias("f")), homed(ids, "id").withColumn("module", F.col("id"))
        visits = flows.groupBy(*keys, F.col("src").alias("id")).agg(F.sum("f").alias("p"))
        units = keep(part.select(*keys, "id").join(visits, [*keys, "id"], "left").withColumn("p", F.coalesce("p", F.lit(0.0))))
        while True:
            begun = len(lengths)
            step = _moved(units, flows, most_rounds, tolerance, lengths, keys, keep)
            if len(lengths) > begun + 1:  # else no round was taken
                part = keep(part.join(step.select(*keys, F.col("id").alias("module"), F.col("module").alias("to")), [*keys, "module"]).select(*keys, "id", F.col("to").alias("module")))
            if len(lengths) == begun + 1 or lengths[begun] - lengths[-1] < tolerance:
                return _named(part.withColumnRenamed("module", "community"), keys)
            units = keep(units.join(step, [*keys, "id"]).groupBy(*keys, F.col("module").alias("id")).agg(F.sum("p").alias("p")))
            at = lambda end, to: step.select(*keys, F.col("id").alias(end), F.col("module").alias(to))
            ends = flows.join(at("src", "s"), [*keys, "src"]).join(at("dst", "d"), [*keys, "dst"])
            flows = keep(ends.where("s <> d").groupBy(*keys, F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("f").alias("f")))


def _apart(ids: DataFrame, flows: DataFrame, most_rounds: int, lengths: list[float]) -> DataFrame:
    """``id``, ``community`` where no component (``home``) is large."""
    spark, kind = flows.sparkSession, flows.schema["src"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def modules(flows: pa.Table, exits: float) -> pa.Table:
        codes, nodes = pd.factorize(np.concatenate([flows[c].to_numpy() for c in ("src", "dst")]), sort=True)
        src, dst, f, n = codes[:len(flows)], codes[len(flows):], flows["f"].to_numpy(), len(nodes)
        homes, _ = pd.factorize(flows["home"].to_numpy())
        home = np.zeros(n, np.int64)
        home[src] = homes
        module = _settled_modules(src, dst, f, home, exits * (1 - np.bincount(homes, weights=f)), most_rounds)
        visits, leaves = np.bincount(src, weights=f, minlength=n), module[src] != module[dst]
        p, q = np.bincount(module, weights=visits, minlength=n), np.bincount(module[src[leaves]], weights=f[leaves], minlength=n) + 0.0
        return pa.table({"id": pa.array(nodes, flows.schema.field("src").type), "community": pa.array(nodes[module], flows.schema.field("src").type), "q": q, "own": _bits(p + q) - 2 * _bits(q)})

    def found(exits: float) -> DataFrame:
        return settled(flows.groupBy("bucket").applyInArrow(lambda group: modules(group, exits), f"id {kind}, community {kind}, q double, own double"), "modules")

    with bucketed_tables(spark, "bucket", buckets) as keep:
        flows = keep(flows.withColumn("bucket", F.pmod(F.xxhash64("home"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket"))
        length = lambda part: part.agg(F.sum("q").alias("q"), F.sum("own").alias("own")).select(_plogp(F.col("q")) + F.col("own"), "q").first()
        alone = flows.groupBy("src").agg(F.sum("f").alias("q"))
        best = alone.select(F.col("src").alias("id"), F.col("src").alias("community"), "q", (_plogp(2 * F.col("q")) - 2 * _plogp(F.col("q"))).alias("own"))
        now, high = length(best)
        lengths.append(now)
        given, low = high, flows.agg(F.min("f")).first()[0]
        while True:
            tried = found(given)
            new, exits = length(tried)
            if new < now - LEAST_GAIN:
                best, now = tried, new
                lengths.append(now)
            # The more exits are given, the fewer are found.
            low, high = (given, high) if exits > given else (low, given)
            if high < 2 * low:
                return settled(ids.join(best.select("id", "community"), "id", "left").select("id", F.coalesce("community", "id").alias("community")), "parts")
            given = (low * high) ** 0.5


def _bits(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)


def _gives(module: np.ndarray, round_: int) -> np.ndarray:
    h = (module.astype(np.uint64) + np.uint64(7919 * round_ + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % 2 == 0


def _settled_modules(src: np.ndarray, dst: np.ndarray, f: np.ndarray, home: np.ndarray, rest: np.ndarray, most_rounds: int) -> np.ndarray:
    """For each node the least of its module.  Of the moves of a round, a component takes all
    if they shorten its description together, or else the one that shortens it most."""
    unit, p, least = np.arange(len(home)), np.bincount(src, weights=f, minlength=len(home)), f.mean() * 1e-6
    while True:
        n = len(home)
        out = np.bincount(src, weights=f, minlength=n)
        at, live, moved = np.arange(n), np.ones(len(rest), bool), False

        def sums(at):
            leaves = at[src] != at[dst]
            big_p, q = np.bincount(at, weights=p, minlength=n), np.bincount(at[src[leaves]], weights=f[leaves], minlength=n)
            own = np.bincount(home, weights=_bits(big_p + q) - 2 * _bits(q), minlength=len(rest))
            all_q = np.maximum(rest, 0.0) + np.bincount(home, weights=q, minlength=len(rest))
            return big_p, q, all_q, own + _bits(all_q)

        big_p, q, all_q, length = sums(at)
        for round_ in range(most_rounds):
            some = live[home[src]]
            keys, inverse = np.unique(src[some] * n + at[dst[some]], return_inverse=True)
            u, b = np.divmod(keys, n)
            fb, a = np.bincount(inverse, weights=f[some], minlength=len(keys)), at[u]
            fa, own = np.zeros(n), a == b
            fa[u[own]] = fb[own]
            u, b, fb, a = u[~own], b[~own], fb[~own], a[~own]
            qa, qb, whole = np.maximum(q[a] - out[u] + 2 * fa[u], 0.0), np.maximum(q[b] + out[u] - 2 * fb, 0.0), all_q[home[u]]
            change = _bits(np.maximum(whole + qa - q[a] + qb - q[b], 0.0)) - _bits(whole) - 2 * (_bits(qa) + _bits(qb) - _bits(q[a]) - _bits(q[b]))
            change += _bits(qa + np.maximum(big_p[a] - p[u], 0.0)) + _bits(qb + big_p[b] + p[u]) - _bits(q[a] + big_p[a]) - _bits(q[b] + big_p[b])
            good = change < -least
            live = np.zeros(len(rest), bool)
            live[home[u[good]]] = True
            if not live.any():
                break
            # In a round a module either gives or takes, so that no two change places.
            good &= _gives(a, round_) & ~_gives(b, round_)
            u, b, change = u[good], b[good], change[good]
            order = np.lexsort((b, change, u))
            order = order[np.diff(u[order], prepend=-1) != 0]
            u, b, change = u[order], b[order], change[order]
            tried = at.copy()
            tried[u] = b
            longer = sums(tried)[3] >= length
            order = np.lexsort((u, change, home[u]))
            best = np.zeros(len(u), bool)
            best[order[np.diff(home[u[order]], prepend=-1) != 0]] = True
            back = longer[home[u]] & ~best
            tried[u[back]] = at[u[back]]
            moved |= bool(len(u))
            at = tried
            big_p, q, all_q, length = sums(at)
        if not moved:
            first = np.full(n, len(unit))
            np.minimum.at(first, unit, np.arange(len(unit)))
            return first[unit]
        # Modules move as wholes.
        names, code = np.unique(at, return_inverse=True)
        unit, home, p = code[unit], home[names], np.bincount(code, weights=p)
        keys, inverse = np.unique(code[src] * len(names) + code[dst], return_inverse=True)
        f = np.bincount(inverse, weights=f)
        src, dst = np.divmod(keys, len(names))
        apart = src != dst
        src, dst, f = src[apart], dst[apart], f[apart]


def description_length(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> float:
    """Bits a step that the map equation gives ``id``, ``community``."""
    w = _weights(edges)
    total = w.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    flows = settled(w.select("src", "dst", (F.col("w") / total).alias("f")), "flows")
    units = nodes.select("id").distinct().join(flows.groupBy(F.col("src").alias("id")).agg(F.sum("f").alias("p")), "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    constant = units.agg(F.sum(_plogp(F.col("p")))).first()[0]
    return _length(_modules(units, flows, communities.select("id", F.col("community").alias("module"))))[0] - constant
