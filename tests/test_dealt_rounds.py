"""Rounds of graph algorithms move what changes, not the graph."""

import random
from contextlib import contextmanager

import pytest

from spindrift.operators import algorithms, communities, neighborhood


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"n{i}"])
def test_components_shrink_from_round_to_round(spark, monkeypatch, name):
    kept, settled = [], algorithms.settled
    monkeypatch.setattr(algorithms, "settled", lambda *a: kept.append(settled(*a)) or kept[-1])
    ids = random.Random(3).sample(range(10_000), 2_000)
    edges = [(a, b) for at in range(0, 2_000, 40) for a, b in zip(ids[at:at + 40], ids[at + 1:at + 40])]
    nodes, df = spark.createDataFrame([(name(i),) for i in [*ids, 10_001]], ["id"]), spark.createDataFrame([(name(a), name(b)) for a, b in edges], ["src", "dst"])
    found = {r["id"]: r["component"] for r in algorithms.components(nodes, df).collect()}
    want = {name(i): min(map(name, ids[at:at + 40])) for at in range(0, 2_000, 40) for i in ids[at:at + 40]}
    assert found == want | {name(10_001): name(10_001)}
    assert sum(t.count() for t in kept) < 12 * len(edges)


def test_relationships_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(neighborhood, "ROWS_A_TASK", 10)  # many tasks
    rnd = random.Random(6)
    rels = [(rnd.randrange(12), rnd.randrange(12), rnd.choice("abc")) for _ in range(60)] + [(20, 21, "a"), (20, 21, "a"), (22, 22, "c")]
    found = neighborhood.summaries(spark.createDataFrame(rels, "src long, dst long, type string"), 9)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for i in {x for a, b, _ in rels for x in (a, b)}:
        out, back = [(b, t) for a, b, t in rels if a == i], [(a, t) for a, b, t in rels if b == i]
        names = lambda e: sorted({t for _, t in e}) or None
        want[i] = (names(out + back), names(out), names(back), len({x for x, _ in out + back}), len(out + back) if len(out + back) > 9 else None)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want


def _page_rank(nodes, edges, damping, iterations):
    """By a loop over all nodes; ``nodes`` may repeat, ends may be no nodes or none."""
    ids = set(nodes)
    out = {i: [b for a, b in edges if a == i and a is not None] for i in ids}
    score = {i: 1 / len(ids) for i in ids}
    for _ in range(iterations):
        lost = sum(s for i, s in score.items() if i is not None and not out[i])
        came = dict.fromkeys(ids, 0.0)
        for i in ids:
            for b in out[i]:
                if b is not None and b in ids:
                    came[b] += score[i] / len(out[i])
        score = {i: (1 - damping + damping * lost) / len(ids) + damping * came[i] for i in ids}
    return score


@pytest.mark.parametrize("rows, name", [(400_000, lambda i: i), (3, lambda i: i if i is None else f"n{i}")])  # the second: nodes with too many edges for a bucket
def test_rounds_of_page_rank_shuffle_what_came_once(spark, monkeypatch, name, rows):
    plans, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    @contextmanager
    def seen(*a):
        with bucketed_tables(*a) as keep:
            def counted(df, *to):
                plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
                return keep(df, *to)

            yield counted

    bucketed_tables = algorithms.bucketed_tables
    monkeypatch.setattr(algorithms, "bucketed_tables", seen)
    monkeypatch.setattr(algorithms, "FEW_ROWS", 10)
    monkeypatch.setattr(algorithms, "ROWS_A_BUCKET", rows)
    rnd = random.Random(9)
    ids = [*range(40), 7, 7, None]  # 35 and above lead nowhere
    edges = [(rnd.randrange(35), rnd.randrange(44)) for _ in range(110)] + [(0, i) for i in range(40)] + [(3, 3), (3, 4), (3, 4), (50, 1), (50, 50), (5, None), (None, 6)]
    ids, edges = [name(i) for i in ids], [(name(a), name(b)) for a, b in edges]
    kind = "long" if isinstance(ids[0], int) else "string"
    nodes, links = spark.createDataFrame([(i,) for i in ids], f"id {kind}"), spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rounds in (4, 0):
            plans.clear()
            found = [tuple(r) for r in algorithms.page_rank(nodes, links, 0.8, rounds).collect()]
            want = _page_rank(ids, edges, 0.8, rounds)
            assert len(found) == len(want) and dict(found) == pytest.approx(want, rel=1e-12)
            if rows > 3:
                assert len(plans) == 3 + rounds and plans[3:] == [1] * rounds
        assert algorithms.page_rank(nodes.limit(0), links).collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["fast_greedy", "walk_trap", "info_map"])
def test_rounds_of_communities_shuffle_nothing(spark, monkeypatch, name):
    """With small components; the same communities come of a graph taken for one with a large one."""
    plans, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    @contextmanager
    def seen(*a):
        with bucketed_tables(*a) as keep:
            def counted(df):
                plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
                return keep(df)

            yield counted

    bucketed_tables = communities.bucketed_tables
    monkeypatch.setattr(communities, "bucketed_tables", seen)
    ids = random.Random(2).sample(range(100), 24)
    edges = spark.createDataFrame([(a, b) for at in (0, 8, 16) for a, b in zip(ids[at:at + 8], ids[at + 1:at + 8])], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sorted(map(tuple, getattr(communities, name)(nodes, edges).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The first deal the tables; a single move is found among all by a sort.
    assert len(plans) > 5 and max(plans[4:]) <= (name == "info_map")
    monkeypatch.setattr(communities, "EDGES_TOGETHER", 2)
    assert sorted(map(tuple, getattr(communities, name)(nodes, edges).collect())) == found
