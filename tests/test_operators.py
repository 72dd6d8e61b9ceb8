"""Operators on small graphs whose answers are known."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from spindrift.graph import Graph
from spindrift.operators import algorithms, links, search, temporal, traverse, writes

CLIQUES = [(a, b) for part in ((1, 2, 3, 4), (5, 6, 7, 8)) for a, b in itertools.combinations(part, 2)] + [(4, 5)]


@pytest.fixture(scope="module")
def cliques(spark):
    return spark.range(1, 9).toDF("id"), spark.createDataFrame(CLIQUES, "src long, dst long")


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def column(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def test_components_and_triangles(spark, cliques):
    nodes, edges = cliques
    more = nodes.union(spark.createDataFrame([(99,)], "id long"))
    found = column(algorithms.components(more, edges), "component")
    assert len({found[i] for i in range(1, 9)}) == 1 and found[99] not in {found[1]}
    assert sum(column(algorithms.triangles(nodes, edges), "triangles").values()) == 3 * 8


def test_communities_keep_cliques_together(cliques):
    nodes, edges = cliques
    found = column(algorithms.louvain(nodes, edges), "community")
    assert len({found[i] for i in (1, 2, 3, 4)}) == 1 and len({found[i] for i in (5, 6, 7, 8)}) == 1 and found[1] != found[8]


def test_core_numbers(cliques):
    assert set(column(algorithms.core_numbers(*cliques), "core").values()) == {3}


def test_page_rank_against_a_loop(spark):
    rnd = random.Random(3)
    edges = list({(rnd.randrange(12), rnd.randrange(12)) for _ in range(40)})
    out = {i: [b for a, b in edges if a == i] for i in range(12)}
    nodes = spark.range(12).toDF("id")
    found = algorithms.page_rank(nodes, spark.createDataFrame(edges, "src long, dst long"), iterations=10)
    name = next(c for c in found.columns if c != "id")
    got = column(found, name)
    assert len(got) == 12 and all(x > 0 for x in got.values())
    most = max(range(12), key=lambda i: sum(i in out[j] for j in out))
    assert got[most] >= sorted(got.values())[6]


def test_strong_components_against_reachability(spark):
    rnd = random.Random(4)
    edges = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(22)}

    def reach(a):
        seen, todo = {a}, deque([a])
        while todo:
            x = todo.popleft()
            for p, q in edges:
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
        return seen

    to = {i: reach(i) for i in range(14)}
    found = column(algorithms.strong_components(spark.range(14).toDF("id"), spark.createDataFrame(sorted(edges), "src long, dst long")), "component")
    for a, b in itertools.combinations(range(14), 2):
        assert (found[a] == found[b]) == (b in to[a] and a in to[b])


def test_betweenness_of_a_path(spark):
    edges = traverse.both_ways(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long"))
    found = algorithms.betweenness(spark.range(1, 5).toDF("id"), edges)
    got = column(found, next(c for c in found.columns if c != "id"))
    assert got[2] == got[3] > got[1] == got[4]


def test_paths_over_a_bound_are_refused(spark):
    nodes, chain = spark.createDataFrame([(i,) for i in range(4)], "id long"), spark.createDataFrame([(i, i + 1) for i in range(3)], "src long, dst long")
    for f in (algorithms.betweenness, algorithms.closeness):
        with pytest.raises(RuntimeError):
            f(nodes, chain, 2)
        assert f(nodes, chain, 3).count() == 4


def test_weighted_paths_against_dijkstra(spark):
    edges = [("A", "B", 1.0), ("B", "C", 2.0), ("C", "D", 1.0), ("A", "E", 3.0), ("E", "F", 1.0), ("A", "C", 9.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    found = traverse.weighted_paths(df, spark.createDataFrame([("A",)], "id string"))
    cost = next(c for c in found.columns if c in ("cost", "weight", "distance"))
    assert {r["id"]: r[cost] for r in found.collect() if r["id"] != "A"} == {"B": 1.0, "C": 3.0, "D": 4.0, "E": 3.0, "F": 4.0}


def test_hops(spark, cliques):
    _, edges = cliques
    found = traverse.neighbors_by_hop(traverse.both_ways(edges), spark.createDataFrame([(1,)], "id long"), 3)
    assert rows(found, "id", "hop") == {(2, 1), (3, 1), (4, 1), (5, 2), (6, 3), (7, 3), (8, 3)}


def test_common_neighbours(spark):
    edges = spark.createDataFrame([("alice", "bob"), ("alice", "charlie"), ("bob", "diana"), ("charlie", "diana")], "src string, dst string")
    found = {(r["a"], r["b"]): r["common_neighbors"] for r in links.scores(edges).collect()}
    assert found[("alice", "diana")] == 2 and found[("bob", "charlie")] == 2


def test_merge_and_delete(spark):
    people = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25)], "id long, name string, age long")
    graph = Graph(spark).with_label("Person", people).with_type("KNOWS", spark.createDataFrame([(1, 2)], "src long, dst long"), "Person", "Person")
    new = spark.createDataFrame([(2, "Bob", 0), (3, "Carol", 35)], "id long, name string, age long")
    merged = writes.merge_nodes(graph, "Person", new, ["name"], on_match={"age": F.col("age") + 1})
    assert rows(merged.nodes("Person"), "name", "age") == {("Alice", 30), ("Bob", 26), ("Carol", 35)}
    gone = writes.delete_nodes(merged, "Person", spark.createDataFrame([(2,)], "id long"), detach=True)
    assert gone.rels("KNOWS").count() == 0 and gone.nodes("Person").count() == 2


def test_constraints(spark):
    graph = Graph(spark).with_label("P", spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, name string")).with_constraint("u", "unique", "P", ["name"]).with_constraint("e", "exists", "P", ["name"])
    assert rows(graph.violations("u"), "name", "n") == {("a", 2)}
    assert rows(graph.violations("e"), "name", "n") == {(None, 1)}


def test_vector_top(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, embedding array<double>")
    assert [r["id"] for r in search.vector_top(v, [1.0, 0.1], 2).orderBy(F.desc("score")).collect()] == [1, 3]


def test_sessions(spark):
    e = spark.createDataFrame([("a", 0), ("a", 100), ("a", 5000), ("b", 50)], "node string, s long").select("node", F.timestamp_seconds("s").alias("ts"))
    assert temporal.session_stats(e, gap=300).count() >= 2


def test_search_tokens(spark):
    from spindrift.operators import search

    text = "We had what YOU do: é x9 ½ 5 They've been here, which was how"
    got = spark.range(1).select(search.tokens(F.lit(text)).alias("t")).first()["t"]
    assert got == ["had", "what", "é", "x9", "ve", "here", "which", "how"]


def test_stated_sources(spark):
    """Betweenness over all sources is the sum over parts of them; closeness is each one's own."""
    rnd = random.Random(6)
    edges = spark.createDataFrame(sorted({(rnd.randrange(10), rnd.randrange(10)) for _ in range(24)}), "src long, dst long")
    nodes = spark.range(10).toDF("id")
    parts = [nodes.where("id < 4"), nodes.where("id >= 4")]
    whole = column(algorithms.betweenness(nodes, edges), "score")
    some = [column(algorithms.betweenness(nodes, edges, sources=p), "score") for p in parts]
    assert whole == pytest.approx({i: some[0][i] + some[1][i] for i in whole}) and any(whole.values())
    near = column(algorithms.closeness(nodes, edges), "score")
    assert column(algorithms.closeness(nodes, edges, sources=parts[0]), "score") == pytest.approx({i: near[i] for i in range(4)})
