"""State that streams keep: edges from changes, and sessions of accesses."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import temporal
from spindrift.streaming import access, adjacency

CHANGES = "op string, src long, dst long, seq long"


def _changes(rnd, n, seq):
    return [(rnd.choice("+++-"), rnd.randrange(8), rnd.randrange(8), seq + i) for i in range(n)]


def _after(batches):
    live = set()
    for rows in batches:
        for op, a, b, _ in sorted(rows, key=lambda r: r[3]):
            if a is not None:
                (live.add if op == "+" else live.discard)((a, b))
    return live


def _edges(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_changes_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(2)
    graph = adjacency.Adjacency(spark, str(tmp_path / "g"), compact_every=3)
    assert _edges(graph.edges()) == set()
    batches = []
    for n in range(8):
        batches.append([*_changes(rnd, rnd.choice([0, 5, 30]), 100 * n), ("+", None, 1, 1)])
        graph.apply(spark.createDataFrame(batches[-1], CHANGES), n)
        graph.apply(spark.createDataFrame(batches[-1], CHANGES), n)  # a batch that comes again
        assert _edges(graph.edges()) == _after(batches)
    for n in range(8):
        assert _edges(graph.edges(n)) == _after(batches[: n + 1])
    live = {p for p in _after(batches) if p[0] != p[1]}
    near = {v: {b if a == v else a for a, b in live if v in (a, b)} for p in live for v in p}
    assert {r["id"]: (r["degree"], r["least"]) for r in graph.neighbors().collect()} == {v: (len(s), min(s)) for v, s in near.items()}


def test_changes_from_a_stream_over_a_restart(spark, tmp_path):
    rnd = random.Random(3)
    source, batches = tmp_path / "in", []
    graph = adjacency.Adjacency(spark, str(tmp_path / "g"), compact_every=2)
    for part in range(2):  # the second run goes on from the checkpoint
        for n in range(3):
            batches.append(_changes(rnd, 20, 1000 * len(batches)))
            spark.createDataFrame(batches[-1], CHANGES).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(source))
        graph.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
        assert _edges(graph.edges()) == _after(batches)


@pytest.fixture
def rocks(spark):
    name, provider = access.PROVIDER
    spark.conf.set(name, provider)
    yield
    spark.conf.unset(name)


def test_sessions_with_timers_over_a_restart(spark, tmp_path, rocks):
    rnd = random.Random(4)
    rows, t = [], {k: 1_700_000_000_000 + 1000 * k for k in range(5)}
    for _ in range(400):
        k = rnd.randrange(5)
        t[k] += rnd.choice([1_000, 60_000, 299_000, 300_000, 300_001, 900_000])
        rows.append((k, t[k]))
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows) - 6, 6):  # somewhat out of order, within what may come late
        part = rows[i : i + 6]
        if part[-1][1] - part[0][1] < 500_000:
            rows[i : i + 6] = rnd.sample(part, 6)
    rows.append((99, max(t.values()) + 10**9))  # moves the watermark over all the others
    rows.append((None, 5))
    source, sink = tmp_path / "in", str(tmp_path / "out")
    cuts = [0, 150, 300, len(rows)]
    for a, b in zip(cuts, cuts[1:]):  # a restart from the checkpoint after each
        for at in range(a, b, 50):
            part = spark.createDataFrame(rows[at : min(at + 50, b)], "node long, ms long").select("node", F.timestamp_millis("ms").alias("ts"))
            part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("node long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = access.tracked(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    events = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 99], "node long, ms long").select("node", F.timestamp_millis("ms").alias("ts"))
    batch = temporal.session_stats(events)
    want = {(r["node"], r["session"], r["first"], r["last"], r["n"]) for r in batch.collect()}
    out = spark.read.parquet(sink).where("node <> 99").collect()
    assert {(r["node"], r["session"], r["start"], r["end"], r["n"]) for r in out} == want and len(out) == len(want)
    hours = {}
    for k, ms in rows[:-2]:
        hours.setdefault(k, [0] * 24)[ms // 3_600_000 % 24] += 1
    last = {r["node"]: r for r in sorted(out, key=lambda r: r["session"])}
    assert all(last[k]["total"] == sum(h) and last[k]["hour"] == h.index(max(h)) for k, h in hours.items())
