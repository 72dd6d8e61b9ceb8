"""Steps that must not grow faster than their input, against plain versions."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from pyspark.sql import functions as F

from spindrift.graph import Graph, Relationships
from spindrift.operators import algorithms, ann, inference, inspection, neighborhood, parts, paths, refactor
from spindrift.plans import patterns


def _joins(df):
    return df._jdf.queryExecution().analyzed().toString().count("Join ")


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"n{i}"])
def test_triangles_without_paths_of_two_edges(spark, monkeypatch, name):
    monkeypatch.setattr(algorithms, "EDGES_A_GROUP", 100)  # many colours
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(250)} | {(0, i) for i in range(1, 40)}
    want = Counter(x for t in itertools.combinations(range(40), 3) if all(p in edges for p in itertools.combinations(t, 2)) for x in t)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges] + [(name(b), name(a)) for a, b in list(edges)[:50]] + [(name(3), name(3))], ["src", "dst"])
    found = algorithms.triangles(spark.createDataFrame([(name(i),) for i in range(42)], ["id"]), df)
    assert {r["id"]: r["triangles"] for r in found.collect()} == {name(i): want[i] for i in range(42)}
    assert _joins(found) == 1  # with the nodes alone


def _events(rnd, n, keys):
    begin = datetime(2024, 1, 1)
    return [(rnd.randrange(keys), begin + timedelta(seconds=rnd.randrange(3000) // 10 * 10)) for _ in range(n)]


def _near(events, seconds):
    return Counter((min(a, b), max(a, b)) for (a, t), (b, u) in itertools.combinations(events, 2) if a != b and abs((t - u).total_seconds()) <= seconds)


def test_co_access_without_pairs_of_accesses(spark, monkeypatch):
    monkeypatch.setattr(inference, "KEYS_A_GROUP", 3)
    events = _events(random.Random(6), 300, 30)
    df = spark.createDataFrame([*events, (None, events[0][1]), (1, None)], "node long, ts timestamp")
    found = inference.co_access_edges(df, seconds=30, least=2)
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == {p: n for p, n in _near(events, 30).items() if n >= 2}
    assert _joins(found) == 0


def test_co_access_counts_in_parts(monkeypatch):
    monkeypatch.setattr(inference, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(inference, "COUNTS_AT_ONCE", 20)
    events = _events(random.Random(7), 200, 12)
    group = pa.table({"k": [k for k, _ in events], "t": pa.array([int(t.timestamp() * 1e6) for _, t in events]), "g": pa.array([k % 2 for k, _ in events], pa.int32())})
    found = {}
    for one, two in ((0, 0), (0, 1), (1, 1)):
        mine = group.filter(pa.compute.is_in(group["g"], pa.array([one, two], pa.int32())))
        for batch in inference._near_in_time(mine, one, two, 30_000_000, 1):
            for r in batch.to_pylist():
                assert (r["a"], r["b"]) not in found
                found[r["a"], r["b"]] = r["n"]
    assert found == dict(_near(events, 30))


def test_closeness_by_bits(spark):
    rnd = random.Random(8)
    edges = [(a, b) for a, b in ((rnd.randrange(150), rnd.randrange(150)) for _ in range(260)) if a != b]
    near = {i: set() for i in range(150)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in range(150):
        hops, todo = {s: 0}, [s]
        for x in todo:
            for y in near[x] - set(hops):
                hops[y] = hops[x] + 1
                todo.append(y)
        want[s] = (len(hops) - 1) ** 2 / (sum(hops.values()) * 149) if len(hops) > 1 else 0.0
    df, nodes = spark.createDataFrame(edges, "src long, dst long"), spark.range(150)
    found = {r["id"]: r["score"] for r in algorithms.closeness(nodes, df).collect()}
    assert found == pytest.approx(want)
    starts = spark.createDataFrame([(i,) for i in range(150)], "id long")
    assert algorithms._numbered(starts).select("block").distinct().count() == 3  # rows a node, not 150


def test_k_shortest_looks_no_further_than_its_hops(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(0, 2, 5.0)], "src long, dst long, weight double")
    reached = []
    plain = paths.costs_from
    monkeypatch.setattr(paths, "costs_from", lambda *a: reached.append(plain(*a)) or reached[-1])
    found = paths.k_shortest(chain, spark.createDataFrame([(0, 3), (0, 30)], "start long, end long"), 3, most_hops=3)
    assert sorted((r["end"], r["cost"], r["nodes"]) for r in found.collect()) == [(3, 3.0, [0, 1, 2, 3]), (3, 6.0, [0, 2, 3])]
    assert reached[0].count() == 7  # within two hops of either end: 3, 2, 1, 0 and 30, 29, 28


def test_a_star_opens_few_nodes(spark):
    n = 400  # on a line, every node joined to the others within ten: the mean weight spans half of what lies between
    edges = [(a, b, float(abs(a - b)) + 1) for a in range(n) for b in range(max(0, a - 10), min(n, a + 11)) if a != b] + [(a, (a * 7 + 200) % n, float(abs(a - (a * 7 + 200) % n)) + 1) for a in range(n)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(n)], "id long, x double, y double")
    found, settled = paths.a_star(df, nodes, spark.createDataFrame([(200, 203)], "start long, end long"))
    assert [(r["cost"], r["nodes"]) for r in found.collect()] == [(4.0, [200, 203])]
    assert settled.count() < 10


def test_fast_rp_by_a_plain_version(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 4), (2, 4)]
    df, nodes = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    near = {i: [b for a, b in edges if a == i] + [a for a, b in edges if b == i] for i in range(1, 6)}
    first = algorithms.fast_rp(nodes, df.where("false"), 8, weights=(1.0,))
    now = {r["id"]: np.sign(r["embedding"]) for r in first.collect()}
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0
    total = {i: v * 0 for i, v in now.items()}
    for w in (1.0, 0.5):
        now = {i: unit(np.mean([now[j] for j in near[i]], axis=0)) if near[i] else now[i] * 0 for i in now}
        total = {i: total[i] + w * now[i] for i in now}
    found = {r["id"]: r["embedding"] for r in algorithms.fast_rp(nodes, df, 8, weights=(0.0, 1.0, 0.5)).collect()}
    for i in total:
        assert found[i] == pytest.approx(list(unit(total[i])), abs=1e-9)


def test_similarity_in_cells(spark, monkeypatch):
    monkeypatch.setattr(inference, "VECTORS_A_CELL", 40)
    rnd = random.Random(9)
    kinds = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = {i: kinds[i % 60] for i in range(150)} | {150: None, 151: [0.0] * 6, 152: [1.0, 2.0], 153: [2.0, 4.0]}
    df = spark.createDataFrame(list(rows.items()), "id long, embedding array<double>")
    found = inference.similarity_edges(df.where("id % 10 < 3"), df, k=5, least=0.3)
    got = {}
    for r in found.collect():
        got.setdefault(r["src"], []).append((-round(r["score"], 9), r["dst"]))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items() if v and any(v)}
    for s in (i for i in rows if i % 10 < 3):
        want = sorted((-round(float(unit[s] @ u), 9), i) for i, u in unit.items() if s in unit and i != s and len(u) == len(unit[s]) and unit[s] @ u >= 0.3)
        assert sorted(got.get(s, [])) == want[:5]
    assert _joins(found) == 0


def test_disjoint_paths_use_only_edges_that_can_carry_flow(spark, monkeypatch):
    """A chain of 300 nodes that leads nowhere, and one that nothing leads to, hang on a small graph."""
    small = [(1, 2), (2, 9), (1, 3), (3, 9), (1, 4), (4, 2)]
    away = [(2, 1000)] + [(i, i + 1) for i in range(1000, 1006)] + [(2000 + i, 2001 + i) for i in range(6)] + [(2006, 3)] + [(3000 + i, 4000 + i) for i in range(300)]
    used = []
    plain = paths._flows
    monkeypatch.setattr(paths, "_flows", lambda e, *a: used.append(e.count()) or plain(e, *a))
    df = spark.createDataFrame(small + away, "src long, dst long")
    found = paths.disjoint_paths(df, spark.createDataFrame([(1, 9), (9, 1)], "start long, end long"))
    assert sorted(r["nodes"] for r in found.collect()) == [[1, 2, 9], [1, 3, 9]]
    assert used == [len(small)]


@pytest.mark.parametrize("name, want", [("neighbors_by_hop", [(2, 1), (3, 2), (4, 3)]), ("shortest_path", [(1, 6, 5)])])
def test_hops_read_pairs_that_were_made_once(spark, monkeypatch, name, want):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long", useArrow=False)
    def seen(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 6)], "src long, dst long")
    monkeypatch.setattr(patterns, "bought_together", lambda g: edges.select(seen.asNondeterministic()("src").alias("src"), "dst"))
    assert sorted(map(tuple, getattr(patterns, name)(spark, "/root/testdata/sf0.001").collect())) == want
    assert made.value == 5


@pytest.mark.parametrize("size", [40, 2_000_000])
def test_rounds_over_parts(spark, monkeypatch, size):
    """Cores, labels and moves don't depend on how edges are dealt, and no edge is joined in a round."""
    monkeypatch.setattr(parts, "EDGES_A_PART", size)
    monkeypatch.setattr(parts, "A_ROW", 7)
    rnd = random.Random(13)
    edges = {tuple(sorted(rnd.sample(range(50), 2))) for _ in range(200)}
    near = {i: [b for a, b in edges if a == i] + [a for a, b in edges if b == i] for i in range(52)}
    df, nodes = spark.createDataFrame(list(edges), "src long, dst long"), spark.range(52)
    core = {i: len(n) for i, n in near.items()}
    while True:
        new = {i: max((min(core[x], k + 1) for k, x in enumerate(sorted(n, key=lambda y: -core[y]))), default=0) for i, n in near.items()}
        if new == core:
            break
        core = new
    assert {r["id"]: r["core"] for r in algorithms.core_numbers(nodes, df).collect()} == core
    label = {i: i for i in near}
    for _ in range(4):
        votes = {i: Counter(label[x] for x in n) for i, n in near.items()}
        label = {i: min(v, key=lambda c: (-v[c], c)) if v else i for i, v in votes.items()}
    assert {r["id"]: r["community"] for r in algorithms.label_propagation(nodes, df, 4).collect()} == label
    assert algorithms.louvain(nodes, df).count() == 52


def test_search_by_index_can_be_complete(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(12)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = ann.VectorIndex.build(df, str(tmp_path / "index"), settings=ann.Settings(links=2, candidates=2))
    asked, plain = df.where("id % 20 = 0"), lambda f: sorted((r["src"], r["dst"], round(r["score"], 9)) for r in f.collect())
    want = plain(inference.similarity_edges(asked, df, k=5, least=-1.0))
    some = inference.similarity_edges_by_index(index, asked, df, k=5, least=-1.0, width=6)
    assert plain(some) != want  # the search alone misses some
    assert plain(inference.similarity_edges_by_index(index, asked, df, k=5, least=-1.0, width=6, complete=True)) == want


def _tasks(df):
    return df.rdd.getNumPartitions()


def test_tasks_grow_with_rows(spark, monkeypatch):
    """Of fixed shuffles, a task would grow with its input."""
    for module in (inspection, neighborhood, refactor):
        monkeypatch.setattr(module, "ROWS_A_TASK", 100)
    rels = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("X").alias("type"))
    ways = refactor.bypasses(rels, rels, rels.select(F.col("dst").alias("id")))
    assert ways.count() == 999 and _tasks(ways) == 20
    pairs = spark.createDataFrame([(1, 2), (2, 1), (5, 9), (1000, 999), (7, 7), (None, 3)], "a long, b long")
    assert sorted((r["a"] or 0, r["b"], r["connected"]) for r in neighborhood.connected(pairs, rels).collect()) == [(0, 3, False), (1, 2, True), (2, 1, True), (5, 9, False), (7, 7, False), (1000, 999, True)]
    graph = Graph(spark, {"N": spark.range(1000)}, {"X": Relationships(rels, "N", "N")})
    missing = inspection.orphans(graph)
    assert [tuple(r) for r in missing.collect()] == [("X", "dst", "1000", 1)] and _tasks(missing) >= 10
    assert "RepartitionByExpression [src" in inspection.analyze(rels, exact=True)._jdf.queryExecution().analyzed().toString()
