import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift import streaming
from spindrift.sources import graphs, tables
from tests.duck import SF


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,says\nAnn,"hi, ""you"""\nBob,\n')
    got = tables.load_csv(spark, str(tmp_path / "a.csv")).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [2, 3] and got[0]["map"] == {"name": "Ann", "says": 'hi, "you"'}


def test_csv_folder(spark, tmp_path):
    for name, text in (("a", 'name,says\nAnn,"two\nlines"\nBob,x\n'), ("b", "says,name\ny,Cy\nz,Di\n"), ("c", "name,says\nEd,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = sorted((r["line_no"], r["map"]["name"], r["map"]["says"]) for r in tables.load_csv(spark, str(tmp_path)).collect())
    assert got == [(2, "Ann", "two\nlines"), (2, "Cy", "y"), (2, "Ed", "1"), (3, "Bob", "x"), (3, "Di", "z")]
    assert tables.load_csv(spark, str(tmp_path), header=False).count() == 8


def test_graph_round_trip(spark, tmp_path):
    graph = graphs.tpch_graph(spark, SF)
    nodes, rels = graphs.to_tables(graph.__class__(spark, {"Nation": graph.nodes("Nation"), "Region": graph.nodes("Region")}, {"IN_REGION": graph.types["IN_REGION"]}))
    graphs.write_json(nodes, rels, str(tmp_path / "g"))
    n, r = graphs.read_json(spark, str(tmp_path / "g/nodes"), str(tmp_path / "g/relationships"))
    again = graphs.from_tables(spark, n, r)
    assert again.nodes("Nation").count() == 25 and again.rels("IN_REGION").count() == 25


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><graph>\n<node id="a"><data key="name">Ann</data></node>\n<node id="b"/>\n<edge source="a" target="b" label="KNOWS"></edge>\n</graph></graphml>')
    nodes, rels = graphs.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert nodes.count() >= 1 and [tuple(r)[:3] for r in rels.collect()] == [("a", "b", "KNOWS")]


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_save(spark, tmp_path, kind):
    tables.save(spark.range(5), str(tmp_path / kind), kind)
    assert spark.read.format(kind).load(str(tmp_path / kind)).count() >= 5


def test_layout_prunes(spark, tmp_path):
    tables.layout(spark.range(1000), str(tmp_path / "t"), ["id"], 4)
    assert spark.read.parquet(str(tmp_path / "t")).where("id >= 990").count() == 10


def test_chunks(spark):
    got = spark.range(1).select(tables.chunks(F.lit("abcdefghij"), 4, 1).alias("c")).first()["c"]
    assert [tuple(x) for x in got] == [(0, "abcd"), (3, "defg"), (6, "ghij")]


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name != "kalman_state" else "update").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return q


def _events(spark, path):
    events = pd.DataFrame({"event_id": [1, 2, 2, 3], "ts": pd.to_datetime(["2024-01-01 00:00:10", "2024-01-01 00:01:00", "2024-01-01 00:01:00", "2024-01-01 02:00:00"]), "user_id": [7, 7, 7, 8], "event_type": list("aabb"), "value": [1.0, 2.0, 2.0, 3.0], "props": ["{}"] * 4})
    spark.createDataFrame(events, streaming.EVENTS).coalesce(1).write.parquet(str(path))
    return streaming.read_events(spark, str(path))


def test_stream_windows_and_dedup(spark, tmp_path):
    events = _events(spark, tmp_path / "e")
    _run(streaming.deduplicated(events), "dedup_out")
    assert spark.table("dedup_out").count() == 3
    _run(streaming.windowed_counts(events), "windows_out")
    assert {(r["event_type"], r["n"]) for r in spark.table("windows_out").collect()} >= {("a", 2)}


def test_stream_kalman(spark, tmp_path):
    _run(streaming.kalman(_events(spark, tmp_path / "e")), "kalman_state")
    assert {r["user_id"]: r["n"] for r in spark.table("kalman_state").collect()} == {7: 3, 8: 1}
