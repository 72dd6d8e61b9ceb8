"""Communities on graphs whose partitions are known."""

import itertools
import math
import random

import pytest

from spindrift.operators import algorithms, communities

FOUND = {"info_map": communities.info_map, "walk_trap": communities.walk_trap, "fast_greedy": communities.fast_greedy}


def _rings(spark, groups, size, seed=1):
    """Cliques in a ring, each joined to the next by one edge, ids mixed."""
    rnd = random.Random(seed)
    ids = rnd.sample(range(1000), groups * size)
    parts = [ids[i * size : (i + 1) * size] for i in range(groups)]
    edges = [p for part in parts for p in itertools.combinations(part, 2)] + [(parts[i][0], parts[(i + 1) % groups][1]) for i in range(groups)]
    rnd.shuffle(edges)
    return parts, spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"), edges


def _parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["community"], set()).add(r["id"])
    assert all(c == min(m) for c, m in out.items())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("name", sorted(FOUND))
def test_cliques_are_kept_apart(spark, name):
    parts, nodes, edges, _ = _rings(spark, 4, 5)
    alone = nodes.union(spark.createDataFrame([(5000,)], "id long"))
    again = edges.union(edges.limit(0)).union(spark.createDataFrame([(parts[0][0], parts[0][0])], "src long, dst long"))
    assert _parts(FOUND[name](alone, again)) == sorted([*map(sorted, parts), [5000]])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_without_edges_every_node_is_alone(spark, name):
    nodes = spark.range(4).toDF("id")
    none = spark.createDataFrame([], "src long, dst long")
    assert _parts(FOUND[name](nodes, none)) == [[0], [1], [2], [3]]
    assert FOUND[name](nodes.where("false"), none).count() == 0


def _bits(parts, edges):
    """The map equation, written out."""
    plogp = lambda x: x * math.log2(x) if x > 0 else 0.0
    w = {}
    for a, b in edges:
        if a != b:
            w[a, b] = w.get((a, b), 0) + 1
            w[b, a] = w.get((b, a), 0) + 1
    total = sum(w.values())
    p = {}
    for (a, _), x in w.items():
        p[a] = p.get(a, 0) + x / total
    at = {i: n for n, part in enumerate(parts) for i in part}
    q = [sum(x / total for (a, b), x in w.items() if at[a] == n != at[b]) for n in range(len(parts))]
    inside = [sum(p.get(i, 0) for i in part) for part in parts]
    return plogp(sum(q)) - 2 * sum(map(plogp, q)) - sum(map(plogp, p.values())) + sum(plogp(a + b) for a, b in zip(q, inside))


def test_description_length(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(24)]
    nodes, df = spark.range(12).toDF("id"), spark.createDataFrame(edges, "src long, dst long")
    parts = [list(range(i, 12, 4)) for i in range(4)]
    given = spark.createDataFrame([(i, min(p)) for p in parts for i in p], "id long, community long")
    assert communities.description_length(nodes, df, given) == pytest.approx(_bits(parts, edges))
    lengths = []
    found = _parts(communities.info_map(nodes, df, lengths=lengths))
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(lengths))
    bits = _bits(found, edges)
    assert bits <= _bits([[i] for i in range(12)], edges) + 1e-9
    # The last length is that of the result, but for the part that nodes add.
    assert lengths[-1] - lengths[0] == pytest.approx(bits - _bits([[i] for i in range(12)], edges))


def test_modularity_of_merges(spark):
    """On the two-clique barbell both merge to the partition of the best modularity."""
    rnd = random.Random(9)
    edges = [p for part in (range(6), range(6, 12)) for p in itertools.combinations(part, 2) if rnd.random() < 0.8] + [(0, 6)]
    nodes, df = spark.range(12).toDF("id"), spark.createDataFrame(edges, "src long, dst long")
    best = algorithms.modularity(df, spark.createDataFrame([(i, i // 6) for i in range(12)], "id long, community long")).first()[0]
    for f in (communities.walk_trap, communities.fast_greedy):
        got = algorithms.modularity(df, f(nodes, df)).first()[0]
        assert got >= 0.9 * best


def test_weights_count(spark):
    df = spark.createDataFrame([(0, 1, 9.0), (1, 2, 0.1), (2, 3, 9.0), (3, 0, 0.1)], "src long, dst long, weight double")
    for f in FOUND.values():
        assert _parts(f(spark.range(4).toDF("id"), df)) == [[0, 1], [2, 3]]
