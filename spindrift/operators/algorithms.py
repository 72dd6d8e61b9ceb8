"""Graph algorithms as loops of joins and aggregations.

``nodes`` has ``id``; ``edges`` has ``src``, ``dst``.  Each round pre-aggregates
by key map-side and is written to the shared folder.  Where an aggregate is joined
back with the edges of each node, it is written first: the adaptive skew join
splits the edges of a hub only if both sides come straight from a shuffle.

What depends on a node's connected component alone is found within tasks that hold whole
components (:func:`spindrift.operators.parts.islands`), unless one of those is large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.iterate import bucketed_tables, settled
from spindrift.operators.parts import Islands, Near, Whole, dealt_parts, islands
from spindrift.operators.traverse import both_ways


def _undirected(edges: DataFrame) -> DataFrame:
    """Each connected pair in both directions, once; no loops."""
    return both_ways(edges.select("src", "dst")).where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``in_degree``, ``out_degree``, ``degree``; parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(d, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree"))).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


#: Rows of a bucket of page rank: few where small files would cost more than tasks gain, and
#: at most; edges from a node that may stay in one.
FEW_ROWS, ROWS_A_BUCKET = 20_000, 400_000


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """``id``, ``score``.  Starts at 1/n; what nodes without outgoing edges hold
    is spread evenly; a fixed number of rounds.

    What all nodes are given alike moves on in the same way whenever it was given.  So
    rounds follow it once, from 1 at every node: what came to each, and what was lost.
    From the latter, a number a round, follows how much was given when; a score is the
    sum of what came, each times that.  Edges and what came stay in buckets by node; with
    a node of too many edges, rounds deal them anew.
    """
    kind = nodes.schema["id"].dataType
    e = settled(edges.select(F.col("src").try_cast(kind).alias("id"), F.col("dst").try_cast(kind).alias("dst")), "edges")
    rows = max(nodes.select("id").count(), e.count())
    buckets = max(1, min(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // FEW_ROWS), -(-rows // ROWS_A_BUCKET))
    with bucketed_tables(e.sparkSession, "id", buckets) as keep:
        ends = keep(nodes.select("id").distinct().join(e.groupBy("id").agg(F.count("*").alias("k")), "id", "left"))
        n = ends.count()
        spread = not ends.where(F.col("k") > ROWS_A_BUCKET).isEmpty()
        put = settled if spread else keep
        # What is lost goes to null.
        ways = (put(ends) if spread else ends).where("id is not null").join(e, "id", "left").where("k is null or dst is not null")
        ways = put(ways.select("id", "dst", F.coalesce(damping / F.col("k"), F.lit(1.0)).alias("w")))
        came = keep(ends.select("id", F.lit(1.0).alias("u"), F.lit(0).alias("round")), "came")
        for i in range(iterations):
            last = came.where(F.col("round") == i).select("id", "u")
            moved = ways.join((put(last) if spread else last).hint("shuffle_hash"), "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("u") * F.col("w")).alias("u"))
            came = keep(moved.withColumn("round", F.lit(i + 1)), "came")
        lost, given = dict(came.where("id is null and round > 0").select(F.col("round") - 1, "u").collect()), [1.0 / max(n, 1)]  # a row a round
        for i in range(iterations):
            given.append((1 - damping + damping * sum(given[i - j] * lost.get(j, 0.0) for j in range(i + 1))) / max(n, 1))
        part = F.col("u") * F.element_at(F.array(*map(F.lit, reversed(given))), F.col("round") + 1)
        score = came.where("id is not null or round = 0").groupBy("id").agg(F.sum(part).alias("score"), F.min("round").alias("first"))
        return settled(score.where("first = 0").select("id", "score"), "rank")  # others are no nodes


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``component``: the least node that is connected, either way.

    In a round each node goes to that one of itself and its neighbours whose hash is
    least; edges between those that were gone to are left for the next.  At least a
    quarter of the nodes with edges are expected to go, so all rounds together move
    some few times the edges.  Hashes differ from round to round.
    """
    e = settled(_undirected(edges.where("src is not null and dst is not null")), "pairs")
    went = []
    while not e.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(went))).alias("h"), F.col(c).alias("to"))
        to = e.groupBy("src").agg(F.min(place("dst")).alias("o"))
        to = settled(to.select(F.col("src").alias("id"), F.least("o", place("src"))["to"].alias("to")), "to")
        went.append(to)
        end = lambda c: to.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        e = e.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))
        e = settled(e.where("src <> dst").distinct(), "pairs")
    # Back from the last round: where a node went, there is the end of its way.
    ends = None
    for to in reversed(went):
        if ends is None:
            ends = to
        else:
            ends = settled(to.join(ends.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", "left").select("id", F.coalesce("end", "to").alias("to")), "ends")
    if ends is None:
        return nodes.select("id").distinct().withColumn("component", F.col("id"))
    least = ends.groupBy("to").agg(F.min("id").alias("component"))
    found = ends.join(least, "to").select("id", "component")
    return nodes.select("id").distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def strong_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``id``, ``component``: nodes that reach each other, by their least node.

    Repeatedly: the greatest colour flows forward until it rests, then each
    colour's root claims what reaches it backward within the colour.
    """
    left = settled(nodes.select("id").distinct(), "left")
    e = settled(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    done = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        colour = left.withColumn("colour", F.col("id"))
        while True:
            up = e.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("colour").alias("c"))
            new = settled(colour.join(up, F.col("id") == F.col("dst"), "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("moved")), "colour")
            moved = new.where("moved").isEmpty()
            colour = new.drop("moved")
            if moved:
                break
        front = settled(colour.where("id = colour"), "front")
        claimed = front
        while not front.isEmpty():
            back = e.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = settled(back.join(colour, ["id", "colour"], "left_semi").join(claimed, ["id", "colour"], "left_anti"), "front")
            claimed = settled(claimed.union(front), "claimed")
        done = claimed if done is None else done.union(claimed)
        left = settled(left.join(claimed, "id", "left_anti"), "left")
        e = settled(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    least = done.groupBy("colour").agg(F.min("id").alias("component"))
    return done.join(least, "colour").select("id", "component")


def _votes(near: Near) -> dict:
    """The label most frequent among the neighbours of each node, the least on ties."""
    codes, names = pd.factorize(near["community"], sort=True)
    node, code = _most(near, codes, len(names))
    return {"id": near.ids[node], "new": names[code]}


def _most(near: Near, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    node, code, n = near.counted(codes, n)
    order = np.lexsort((code, -n, node))
    first = order[np.concatenate(([True], np.diff(node[order]) != 0))]
    return node[first], code[first]


def _labels(near: Whole, iterations: int) -> dict:
    label = np.arange(len(near.ids))
    for _ in range(iterations if len(near.src) else 0):
        node, code = _most(near, label, len(label))
        if (label[node] == code).all():
            break
        label = label.copy()
        label[node] = code
    return {"id": near.ids, "new": near.ids[label]}


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 20) -> DataFrame:
    """``id``, ``community``.  All nodes take at once the label most frequent
    among their neighbours (the least on ties) until none changes."""
    e = settled(edges.select("src", "dst"), "edges")
    kind = e.schema["src"].dataType.simpleString()
    if found := islands(e):
        new = found.each(nodes.select("id").distinct(), lambda near: _labels(near, iterations), f"id {kind}, new {kind}")
        return settled(nodes.select("id").join(new, "id", "left").select("id", F.coalesce("new", "id").alias("community")), "labels")
    e = settled(_undirected(e), "edges")
    labels = settled(nodes.select("id", F.col("id").alias("community")), "labels")
    with dealt_parts(e) as parts:
        for _ in range(iterations):
            best = parts.round(labels, _votes, f"id {kind}, new {kind}")
            step = settled(labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"), (F.coalesce("new", "community") != F.col("community")).alias("moved")), "labels")
            labels = step.drop("moved")
            if step.where("moved").isEmpty():
                break
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, ``modularity``: of undirected edges under ``id``, ``community``."""
    c = communities.select("id", "community")
    e = edges.select("src", "dst").join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    ends = e.select("a").union(e.select("b")).groupBy("a").agg(F.count("*").alias("k"))
    inside = e.where("a = b").groupBy("a").agg(F.count("*").alias("inside"))
    m = e.agg(F.count("*").alias("m"))
    return ends.join(inside, "a", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("modularity"))


def louvain(nodes: DataFrame, edges: DataFrame, passes: int = 10) -> DataFrame:
    """``id``, ``community`` by local moves for the greatest gain of modularity.

    In a pass, all nodes weigh their neighbours' communities at once; those whose
    hash is even in that pass may move, so that neighbours seldom swap.
    """
    e = settled(edges.select("src", "dst"), "edges")
    kind = e.schema["src"].dataType.simpleString()
    may = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0
    if found := islands(e):
        turns = nodes.select("id", *(may(i).cast("int").alias(f"may{i}") for i in range(passes))).distinct()
        m2 = 2 * found.pairs
        to = found.each(turns, lambda near: _passes(near, m2, passes), f"id {kind}, to {kind}")
        return settled(nodes.select("id").join(to, "id", "left").select("id", F.coalesce("to", "id").alias("community")), "parts")
    e = settled(_undirected(e), "edges")
    k = settled(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "degrees")
    m2 = e.count()
    part = settled(nodes.select("id", F.col("id").alias("community")), "parts")
    if not m2:
        return part
    with dealt_parts(e) as parts:
        for i in range(passes):
            here = part.join(k, "id")
            total = here.groupBy("community").agg(F.sum("k").alias("total"))
            willing = settled(parts.round(here.join(total, "community"), lambda near: _gains(near, m2), f"id {kind}, to {kind}"), "moves")
            if willing.isEmpty():
                break
            part = settled(part.join(willing.where(may(i)), "id", "left").select("id", F.coalesce("to", "community").alias("community")), "parts")
    return part


def _gains(near: Near, m2: int) -> dict:
    """The neighbouring community of the greatest gain, where that is more than staying gives."""
    codes, names = pd.factorize(near["community"], sort=True)
    total = np.zeros(len(names), np.int64)
    total[codes] = near["total"]
    node, code = _gaining(near, codes, near["k"], total, m2)
    return {"id": near.ids[node], "to": names[code]}


def _gaining(near: Near, codes: np.ndarray, k: np.ndarray, total: np.ndarray, m2: int) -> tuple[np.ndarray, np.ndarray]:
    node, code, links = near.counted(codes, len(total))
    own = code == codes[node]
    gain = links - (k[node] * (total[code] - np.where(own, k[node], 0))) / m2
    stay = -(k * (total[codes] - k)) / m2
    stay[node[own]] = gain[own]
    scored = np.sign(gain) * np.floor(np.abs(gain) * 1e9 + 0.5) / 1e9
    order = np.lexsort((code, -scored, node))
    first = order[np.concatenate(([True], np.diff(node[order]) != 0))]
    first = first[scored[first] > stay[node[first]] + 1e-9]
    return node[first], code[first]


def _passes(near: Whole, m2: int, passes: int) -> dict:
    codes = np.arange(len(near.ids))
    for i in range(passes if len(near.src) else 0):
        total = np.bincount(codes, weights=near.degree * near.has, minlength=len(codes)).astype(np.int64)
        node, code = _gaining(near, codes, near.degree, total, m2)
        some = near[f"may{i}"][node] == 1
        if not len(node):
            break
        codes = codes.copy()
        codes[node[some]] = code[some]
    return {"id": near.ids, "to": near.ids[codes]}


#: Edges that one group of a count of triangles holds, and that a packed row holds at most.
EDGES_A_GROUP, EDGES_A_ROW = 8_000_000, 1 << 18
#: Paths of two edges looked at together.
PATHS_AT_ONCE = 1 << 22


def _pairs(edges: DataFrame) -> DataFrame:
    """Each connected pair once, lesser end first; no loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``triangles``.

    Nodes are dealt into colours, and an edge goes to the group of each three
    colours that holds both of its own: a triangle lies whole in the group of its
    colours.  Edges move a number of times that grows with the root of their
    number, the paths of two edges never; a group holds a bounded number.
    """
    e = settled(edges.select("src", "dst"), "edges")
    if found := islands(e):
        each = _whole_triangles(nodes, found)
        return nodes.select("id").join(each, "id", "left").select("id", F.coalesce("triangles", F.lit(0).cast("long")).alias("triangles"))
    return _triangles(nodes, settled(_pairs(e), "edges"))


def _whole_triangles(nodes: DataFrame, found: Islands) -> DataFrame:
    """``id``, ``triangles``, ``d`` of nodes with edges."""
    def count(near: Whole) -> dict:
        n = len(near.ids)
        return {"id": near.ids, "triangles": _counted_triangles(*near.every, np.zeros(n, np.int64), 0), "d": near.degree}

    kind = found.at.schema["id"].dataType.simpleString()
    return settled(found.each(nodes.select("id").distinct(), count, f"id {kind}, triangles long, d long"), "triangles")


def _packed(batches):
    """Rows ``x``, ``y``, ``src``, ``dst`` as one row for each ``x`` and ``y``, with the ends as lists."""
    def rows(held):
        t = pa.Table.from_batches(held).sort_by([("x", "ascending"), ("y", "ascending")]).combine_chunks()
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        at = np.concatenate(([0], np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1))
        ends = pa.array(np.append(at, len(x)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)) for c in ("src", "dst")]
        return pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(y[at]), *lists], ["x", "y", "src", "dst"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= EDGES_A_ROW:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def _triangles_of_a_group(group: pa.Table) -> pa.Table:
    """``id``, ``n``: triangles whose three colours are those of the group."""
    flat = lambda c: np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in group[c].chunks])
    src, dst = flat("src"), flat("dst")
    size = np.concatenate([v.value_lengths().to_numpy() for v in group["src"].chunks])
    colour = np.concatenate([np.repeat(group[c].to_numpy(), size) for c in ("x", "y")])
    code, ids = pd.factorize(np.concatenate((src, dst)))
    at = np.empty(len(ids), np.int64)
    at[code] = colour
    found = _counted_triangles(code[:len(src)], code[len(src):], at, group["whole"][0].as_py())
    seen = np.flatnonzero(found)
    return pa.table({"id": pa.array(ids[seen], group.schema.field("src").type.value_type), "n": found[seen]})


def _counted_triangles(src: np.ndarray, dst: np.ndarray, colour: np.ndarray, whole: int) -> np.ndarray:
    """By place, triangles of the pairs whose three colours add up to ``whole``."""
    n, m = len(colour), len(src)
    # From the end of lower degree to that of higher: a hub starts few paths.
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(src, minlength=n) + np.bincount(dst, minlength=n), kind="stable")] = np.arange(n)
    src, dst, at = rank[src], rank[dst], np.empty(n, np.int64)
    at[rank] = colour
    key = np.sort(np.minimum(src, dst) * n + np.maximum(src, dst))
    u, v = np.divmod(key, n)
    first = np.searchsorted(u, np.arange(n + 1))
    fan = np.diff(first)[v]
    upto = np.concatenate(([0], np.cumsum(fan)))
    found, low = np.zeros(n, np.int64), 0
    while low < m:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + PATHS_AT_ONCE, "right")) - 1)
        k = fan[low:high]
        a, b = np.repeat(u[low:high], k), np.repeat(v[low:high], k)
        c = v[np.repeat(first[v[low:high]] - upto[low:high], k) + np.arange(upto[low], upto[high])]
        sought = a * n + c
        hit = key[np.minimum(np.searchsorted(key, sought), m - 1)] == sought
        a, b, c = a[hit], b[hit], c[hit]
        hit = at[a] + at[b] + at[c] == whole  # others, of one colour alone, have a group of their own
        found += np.bincount(np.concatenate((a[hit], b[hit], c[hit])), minlength=n)
        low = high
    return found[rank]


def _triangles(nodes: DataFrame, e: DataFrame) -> DataFrame:
    kind = e.schema["src"].dataType.simpleString()
    p = max(4, int(np.ceil(np.sqrt(6 * e.count() / EDGES_A_GROUP))))
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    turned = e.withColumns({"x": colour("src"), "y": colour("dst")})
    end = lambda a, b, name: F.when(F.col("x") <= F.col("y"), F.col(a)).otherwise(F.col(b)).alias(name)
    packed = turned.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), end("src", "dst", "src"), end("dst", "src", "dst")).mapInArrow(_packed, f"x int, y int, src array<{kind}>, dst array<{kind}>")
    three = F.array_sort(F.array("x", "y", "z"))
    cells = packed.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("cell", (three[0] * p + three[1]) * p + three[2]).withColumn("whole", F.col("x") + F.col("y") + F.col("z")).drop("z")
    found = cells.repartition(p * (p + 1) * (p + 2) // 6, "cell").groupBy("cell").applyInArrow(_triangles_of_a_group, f"id {kind}, n long")
    each = found.groupBy("id").agg(F.sum("n").alias("triangles"))
    return nodes.select("id").join(each, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``triangles``, ``coefficient``: triangles of those its pairs of
    neighbours could make."""
    e = settled(edges.select("src", "dst"), "edges")
    if found := islands(e):
        each = nodes.select("id").join(_whole_triangles(nodes, found), "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    else:
        e = settled(_pairs(e), "edges")
        d = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        each = _triangles(nodes, e).join(d, "id", "left")
    return each.select("id", "triangles", F.coalesce(F.try_divide(2 * F.col("triangles"), F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("coefficient"))


def _cores(near: Near) -> dict:
    """Estimates that fall, with those of other parts as they are, until none of the part's does."""
    core = near["core"]
    begun = core.copy()
    _rest(near, core)
    fell = np.flatnonzero(core < begun)
    return {"id": near.ids[fell], "h": core[fell]}


def _whole_cores(near: Whole) -> dict:
    """Nodes are taken away, those of fewest neighbours left first; work follows what is taken."""
    dst, left = near.dst, np.bincount(near.src, minlength=len(near.ids))
    first = np.concatenate(([0], np.cumsum(left)))
    core, level = np.full(len(left), -1), 0
    rest = np.arange(len(left))
    while len(rest):
        level = max(level, int(left[rest].min()))
        taken = rest[left[rest] <= level]
        while len(taken):
            core[taken] = level
            n = first[taken + 1] - first[taken]
            upto = np.cumsum(n)
            theirs = dst[np.repeat(first[taken] - (upto - n), n) + np.arange(upto[-1])]
            theirs, fewer = np.unique(theirs[core[theirs] < 0], return_counts=True)
            left[theirs] -= fewer
            taken = theirs[left[theirs] <= level]
        rest = rest[core[rest] < 0]
    return {"id": near.ids, "core": core}


def _rest(near: Near, core: np.ndarray) -> None:
    src, dst = near.src, near.dst
    mine = np.unique(src)
    while True:
        enough = np.bincount(src[core[dst] >= core[src]], minlength=len(core))
        falls = np.zeros(len(core), bool)
        falls[mine] = enough[mine] < core[mine]
        if not falls.any():
            break
        # For each that falls, how many neighbours have estimates of 0, 1, ... up to its own or more.
        nodes = np.flatnonzero(falls)
        first = np.concatenate(([0], np.cumsum(core[nodes] + 1)))
        start = np.zeros(len(core), np.int64)
        start[nodes] = first[:-1]
        some = falls[src]
        node, theirs = src[some], core[dst[some]]
        counts = np.bincount(start[node] + np.minimum(theirs, core[node]), minlength=first[-1])
        before = np.concatenate(([0], np.cumsum(counts)))
        h = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
        more = np.repeat(before[first[1:]], np.diff(first)) - before[:-1]
        core[nodes] = np.maximum.reduceat(np.where(more >= h, h, 0), first[:-1])


def core_numbers(nodes: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``id``, ``core``.  Each node's estimate falls to the greatest h such that
    h neighbours have estimates of h or more, until none falls; nodes of one part
    fall until they rest before the others hear of it."""
    e = settled(edges.select("src", "dst"), "edges")
    kind = e.schema["src"].dataType.simpleString()
    whole = lambda known: settled(nodes.select("id").join(known, "id", "left").withColumn("core", F.coalesce("core", F.lit(0).cast("long"))), "core")
    if found := islands(e):
        return whole(found.each(nodes.select("id").distinct(), _whole_cores, f"id {kind}, core long"))
    e = settled(_undirected(e), "edges")
    core = whole(e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")))
    with dealt_parts(e) as parts:
        for _ in range(most_rounds):
            fell = settled(parts.round(core, _cores, f"id {kind}, h long"), "fell")
            if fell.isEmpty():
                return core
            core = settled(core.join(fell, "id", "left").select("id", F.least("core", "h").alias("core")), "core")
    raise RuntimeError("core numbers did not settle")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, ``density``: connected pairs of all pairs."""
    n = nodes.agg(F.count_distinct("id").alias("n"))
    return _undirected(edges).agg(F.count("*").alias("m")).crossJoin(n).select(F.coalesce(F.try_divide("m", F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"))


def conductance(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``community``, ``conductance``: edges that leave of all edge ends inside,
    or outside if those are fewer."""
    c = communities.select("id", "community")
    e = _undirected(edges).join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    per = e.groupBy("a").agg(F.count("*").alias("ends"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("cut"))
    total = e.agg(F.count("*").alias("all_ends"))
    return per.crossJoin(F.broadcast(total)).select(F.col("a").alias("community"), F.coalesce(F.try_divide("cut", F.least("ends", F.col("all_ends") - F.col("ends"))), F.lit(0.0)).alias("conductance"))


def _levels(edges: DataFrame, sources: DataFrame, most: int | None) -> list[DataFrame]:
    """Breadth first from each source: ``s``, ``id``, ``paths`` by level, until a
    level is empty; an error if there are more than ``most``."""
    level = settled(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "level")
    seen, out = level.select("s", "id"), [level]
    while True:
        step = level.join(edges, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = settled(step.join(seen, ["s", "id"], "left_anti"), "level")
        if level.isEmpty():
            return out
        if most is not None and len(out) > most:
            raise RuntimeError("shortest paths are longer than most_hops")
        out.append(level)
        seen = seen.union(level.select("s", "id"))


def betweenness(nodes: DataFrame, edges: DataFrame, most_hops: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``id``, ``score``: shortest outgoing paths through a node, scaled by
    2 / ((n - 1)(n - 2)).  Dependencies flow back level by level.  Paths of any
    length count; over ``most_hops``, if given, is an error.

    Every node is a start, which takes a row for each pair of nodes that are
    connected; ``sources`` (``id``), a stated set, bounds that, and only paths from
    them count then, in the same scale."""
    e = settled(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    n = nodes.count()
    levels = _levels(e, nodes if sources is None else sources, most_hops)
    share = None
    sums = []
    for depth in range(len(levels) - 1, 0, -1):
        low = levels[depth].withColumn("d", F.lit(0.0)) if share is None else levels[depth].join(share, ["s", "id"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
        sums.append(low.select("id", "d"))
        up = levels[depth - 1].select("s", F.col("id").alias("u"), F.col("paths").alias("up"))
        share = low.join(e, F.col("id") == F.col("dst")).join(up, (F.col("src") == F.col("u")) & (low["s"] == up["s"])).groupBy(low["s"], F.col("u").alias("id")).agg(F.sum(F.col("up") / F.col("paths") * (1 + F.col("d"))).alias("d"))
        share = settled(share, "share")
    total = None
    for d in sums:
        total = d if total is None else total.union(d)
    scale = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("score"))
    return nodes.select("id").join(total.groupBy("id").agg(F.sum("d").alias("d")), "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("score"))


#: Starts that one number holds as bits.
STARTS = 64


def closeness(nodes: DataFrame, edges: DataFrame, most_hops: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``id``, ``score``: reached squared over total distance times n - 1,
    edges taken both ways.  Paths of any length count; over ``most_hops``, if
    given, is an error.  With ``sources`` (``id``), a stated set, only theirs.

    Starts that are next to each other in order go together, ``STARTS`` of them as
    the bits of a number: a level is a row for each node and number, and what is new
    at a node is found by its bits.
    """
    e = settled(edges.select("src", "dst"), "edges")
    n = nodes.count()
    asked = nodes if sources is None else sources
    score = lambda sums: asked.select("id").join(sums, "id", "left").select("id", F.coalesce(F.try_divide(F.col("reached") * F.col("reached"), F.col("total") * F.lit(max(1, n - 1))), F.lit(0.0)).alias("score"))
    if most_hops is None and (found := islands(e)):
        return score(found.each(asked.select("id").distinct(), _hops, f"id {e.schema['src'].dataType.simpleString()}, reached long, total long"))
    e = settled(_undirected(e), "edges")
    numbered = settled(_numbered(settled(asked.select("id").where("id is not null").distinct(), "asked")), "starts")
    level = settled(numbered.groupBy("id", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "level")
    seen, far, hop = level, None, 0
    while True:
        step = level.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))
        step = step.join(seen.withColumnRenamed("bits", "old"), ["id", "block"], "left")
        level = settled(step.select("id", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"), "level")
        if level.isEmpty():
            break
        if most_hops is not None and hop >= most_hops:
            raise RuntimeError("shortest paths are longer than most_hops")
        hop += 1
        ones = level.groupBy("block").agg(F.array(*(F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))) for i in range(STARTS))).alias("ones"))
        d = ones.select("block", F.posexplode("ones").alias("bit", "n")).withColumn("hop", F.lit(hop))
        far = d if far is None else far.union(d)
        seen = settled(seen.union(level).groupBy("id", "block").agg(F.bit_or("bits").alias("bits")), "seen")
    if far is None:
        return asked.select("id", F.lit(0.0).alias("score"))
    return score(far.groupBy("block", "bit").agg(F.sum("n").alias("reached"), F.sum(F.col("n") * F.col("hop")).alias("total")).join(numbered, ["block", "bit"]).select("id", "reached", "total"))


def _hops(near: Whole) -> dict:
    """Of each start, how many nodes are reached and their hops in all; ``STARTS`` at once."""
    src, dst = (np.concatenate((a, b)) for a, b in (near.every, near.every[::-1]))
    dst, starts = dst[np.argsort(src, kind="stable")], np.flatnonzero(near.has)
    first = np.concatenate(([0], np.cumsum(near.degree)[:-1]))
    reached, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for low in range(0, len(starts), STARTS):
        some = starts[low:low + STARTS]
        new = np.zeros(len(near.ids), np.uint64)
        new[some] = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
        seen, hop = new.copy(), 0
        while new.any():
            new = np.bitwise_or.reduceat(new[dst], first) & ~seen
            seen, hop = seen | new, hop + 1
            ones = np.array([np.count_nonzero(new & (np.uint64(1) << np.uint64(i))) for i in range(len(some))])
            reached[low:low + STARTS] += ones
            total[low:low + STARTS] += ones * hop
    return {"id": near.ids[starts], "reached": reached, "total": total}


def _numbered(ids: DataFrame) -> DataFrame:
    """``id``, ``block``, ``bit``: ids in order within their range, ``STARTS`` a block."""
    spread = ids.repartitionByRange(1 + ids.count() // (1024 * STARTS), "id").withColumn("part", F.spark_partition_id())
    turn = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return spread.withColumn("turn", turn).select("id", F.concat_ws("/", "part", F.floor(F.col("turn") / STARTS)).alias("block"), (F.col("turn") % STARTS).cast("int").alias("bit"))


def fast_rp(nodes: DataFrame, edges: DataFrame, dimension: int = 64, weights=(0.0, 1.0, 1.0, 1.0), seed: int = 42) -> DataFrame:
    """``id``, ``embedding``: random projections averaged over neighbours.

    Each dimension starts at -1, 0 or 1 with odds 1/6, 2/3, 1/6 by a hash of
    node, dimension and seed; each round takes the neighbours' mean, normalised;
    rounds are added with ``weights`` and normalised.
    """
    e = settled(edges.select("src", "dst"), "edges")
    dims = F.sequence(F.lit(0), F.lit(dimension - 1))
    u = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(6))
    now = nodes.select("id", F.transform(dims, lambda i: F.when(u(i) == 0, -1.0).when(u(i) == 1, 1.0).otherwise(0.0)).alias("v"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: F.transform(c, lambda x: F.coalesce(F.try_divide(x, norm(c)), F.lit(0.0)))
    total = now.select("id", F.transform("v", lambda x: x * weights[0]).alias("sum"))
    if found := islands(e):
        summed = found.each(now.dropDuplicates(["id"]), lambda near: _projected(near, weights), f"id {e.schema['src'].dataType.simpleString()}, whole array<double>")
        return total.join(summed, "id", "left").select("id", unit(F.coalesce("whole", "sum")).alias("embedding"))
    e = settled(_undirected(e), "edges")
    for w in weights[1:]:
        # A column for each dimension: sums of a node are one row, not a row for each dimension.
        sums = e.join(now, F.col("src") == F.col("id")).groupBy("dst").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dimension)))
        mean = sums.select("dst", F.array(*(F.col(f"s{i}") / F.col("n") for i in range(dimension))).alias("m"))
        now = settled(nodes.select("id").join(mean, F.col("id") == F.col("dst"), "left").select("id", unit(F.coalesce("m", F.array_repeat(F.lit(0.0), dimension))).alias("v")), "embedding")
        total = settled(total.join(now, "id").select("id", F.zip_with("sum", "v", lambda a, b: a + b * w).alias("sum")), "sum")
    return total.select("id", unit(F.col("sum")).alias("embedding"))


def _projected(near: Whole, weights: tuple[float, ...]) -> dict:
    now = np.stack(near["v"]) * near.has[:, None]
    total, n = now * weights[0], np.bincount(near.src, minlength=len(near.ids))
    for w in weights[1:]:
        now = np.stack([np.bincount(near.src, weights=v[near.dst], minlength=len(n)) for v in now.T], axis=1) / np.maximum(n, 1)[:, None]
        norm = np.sqrt((now * now).sum(axis=1))[:, None]
        now = np.divide(now, norm, out=np.zeros_like(now), where=norm > 0)
        total = total + w * now
    return {"id": near.ids, "whole": pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * now.shape[1], total.ravel())}
