"""The map equation where components are small: some jobs, not one for each round."""

import itertools

import pytest

from spindrift.operators import communities


def test_small_components_need_no_rounds_of_jobs(spark, monkeypatch):
    rings = [range(20 * k, 20 * k + 20) for k in range(12)]  # each of four cliques of five in a ring
    edges = [p for r in rings for c in range(4) for p in itertools.combinations(r[5 * c:5 * c + 5], 2)] + [(r[5 * c], r[(5 * c + 6) % 20]) for r in rings for c in range(4)]
    nodes, df = spark.range(241).toDF("id"), spark.createDataFrame(edges, "src long, dst long")

    def unused(*a):
        raise AssertionError("a job for each round")

    monkeypatch.setattr(communities, "_moved", unused)
    lengths = []
    found = communities.info_map(nodes, df, lengths=lengths)
    assert {r["id"]: r["community"] for r in found.collect()} == {i: i // 5 * 5 for i in range(241)}
    alone = communities.description_length(nodes, df, nodes.selectExpr("id", "id AS community"))
    assert lengths[-1] - lengths[0] == pytest.approx(communities.description_length(nodes, df, found) - alone)
