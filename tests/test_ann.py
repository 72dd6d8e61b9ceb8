"""The vector index against a full scan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.operators import ann, inference, search


def _table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        return spark.createDataFrame(pd.DataFrame({"id": list(ids), "embedding": [v.astype("float32") for v in vectors]}), "id long, embedding array<float>")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")


def _best(vectors, queries, k):
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.argsort(-(unit(queries) @ unit(vectors).T), axis=1, kind="stable")[:, :k]


def _found(df):
    out = {}
    for r in df.orderBy("query", F.desc("score"), "id").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


def test_recall_on_fifty_thousand(spark, tmp_path):
    """Random vectors without any clusters, the hardest kind."""
    rnd = np.random.default_rng(7)
    vectors, queries = rnd.random((50_000, 64), dtype=np.float32), rnd.random((200, 64), dtype=np.float32)
    index = ann.VectorIndex.build(_table(spark, vectors), str(tmp_path / "index"))
    got = _found(index.search(_table(spark, queries), k=10))
    best = _best(vectors, queries, 10)
    share = np.mean([len(set(got[i]) & set(best[i].tolist())) / 10 for i in range(200)])
    assert share >= 0.9
    # The library's own scan agrees with the plain one.
    scan = search.vector_top(_table(spark, vectors), queries[0].tolist(), 10)
    assert [r["id"] for r in scan.collect()] == best[0].tolist()


def test_near_copies_are_found(spark, tmp_path):
    """Large groups of near copies must not cut the graph in parts."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 32))
    vectors = np.concatenate([c + 0.01 * rnd.normal(size=(400, 32)) for c in centres] + [rnd.normal(size=(600, 32))])
    index = ann.VectorIndex.build(_table(spark, vectors), str(tmp_path / "index"), settings=ann.Settings(rows_per_shard=1500))
    queries = np.concatenate([centres, rnd.normal(size=(44, 32))])
    got = _found(index.search(_table(spark, queries), k=10))
    best = _best(vectors, queries, 10)
    assert np.mean([len(set(got[i]) & set(best[i].tolist())) / 10 for i in range(50)]) >= 0.9


def test_insert_remove_compact(spark, tmp_path):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(900, 16))
    index = ann.VectorIndex.build(_table(spark, vectors[:600]), str(tmp_path / "a"), settings=ann.Settings(rows_per_shard=300))
    index.insert(_table(spark, vectors[600:], range(600, 900)))
    assert index.size() == 900
    queries = _table(spark, vectors[[5, 650]], [5, 650])
    got = _found(index.search(queries, k=10, width=200))
    assert got[5] == _best(vectors, vectors[[5]], 10)[0].tolist() and got[650] == _best(vectors, vectors[[650]], 10)[0].tolist()
    index.remove(spark.createDataFrame([(5,), (650,), (12345,)], "id long"))
    got = _found(index.search(queries, k=9, width=200))
    assert 5 not in got[5] and got[5] == _best(vectors, vectors[[5]], 10)[0].tolist()[1:]
    assert index.size() == 898
    index.insert(_table(spark, -vectors[[7]], [7]))  # takes the place of the vector it had
    got = _found(index.search(_table(spark, vectors[[7]], [7]), k=899, width=900))
    assert got[7][-1] == 7 and index.size() == 898
    index.insert(_table(spark, vectors[[5]], [5]))  # back again
    assert _found(index.search(queries, k=1, width=200))[5] == [5]
    small = index.compact(str(tmp_path / "b"))
    assert small.size() == 899 and small._graph().agg(F.max("segment")).first()[0] == 0
    assert _found(small.search(queries, k=1, width=200))[5] == [5]


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [None, 1.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = ann.VectorIndex.build(table, str(tmp_path / "index"))
    assert sorted(r["id"] for r in index.vectors().collect()) == [1, 6]
    got = _found(index.search(spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "id long, embedding array<float>")))
    assert got == {1: [1, 6]}
    empty = ann.VectorIndex.build(table.where("false"), str(tmp_path / "empty"))
    assert empty.size() == 0 and empty.search(table.where("id = 1").limit(1)).count() == 0
    assert index.search(table.where("id = 6"), least=0.9).collect()[0][1:] == (6, pytest.approx(1.0))


def test_similarity_edges_by_index(spark, tmp_path):
    rnd = np.random.default_rng(9)
    table = _table(spark, rnd.normal(size=(400, 16)))
    queries = table.where("id % 50 = 0")
    index = ann.VectorIndex.build(table, str(tmp_path / "index"))
    exact = {(r["src"], r["dst"]): r["score"] for r in inference.similarity_edges(queries, table, k=5, least=0.1).collect()}
    found = {(r["src"], r["dst"]): r["score"] for r in inference.similarity_edges_by_index(index, queries, table, k=5, least=0.1).collect()}
    assert found.keys() == exact.keys() and all(found[p] == pytest.approx(exact[p]) for p in exact)
    measured = ann.recall(index.search(queries, k=5).select("query", "id"), spark.createDataFrame([(0, 0), (0, 9999)], "query long, id long"))
    assert measured.first()[0] == 0.5
