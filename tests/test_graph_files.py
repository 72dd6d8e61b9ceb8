"""GraphML and nested documents, there and back."""

import glob
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql.types import StructType

from spindrift.sources import documents, graphs

NODES = [("a", ["Person", "Cook"], {"name": 'Zoë & "Al" <x>', "note": " two\nlines\tand\r more "}), ("b&1", [], {"empty": "", "gone": None}), ("c", ["City"], None), (None, ["Lost"], {})]
RELS = [("a", "b&1", "KNOWS", {"since": "1999"}), ("b&1", "c", None, None), ("a", "a", "LIKES<>", {"x\x01": "\x02"}), ("a", None, "LOST", {})]


def _tables(spark):
    nodes = spark.createDataFrame(NODES * 1, "id string, labels array<string>, properties map<string,string>").repartition(3)
    return nodes, spark.createDataFrame(RELS, "src string, dst string, type string, properties map<string,string>").repartition(2)


def test_graphml_is_one_document(spark, tmp_path):
    path = str(tmp_path / "g.graphml")
    graphs.write_graphml(*_tables(spark), path)
    parts = sorted(glob.glob(f"{path}/part-*"))
    root = ET.fromstring("".join(open(p, encoding="utf-8").read() for p in parts))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    data = lambda e: {d.get("key"): d.text or "" for d in e.findall(f"{space}data")}
    nodes = {n.get("id"): data(n) for n in root.iter(f"{space}node")}
    assert nodes == {"a": {"name": 'Zoë & "Al" <x>', "note": " two\nlines\tand\r more ", "labels": ":Person:Cook"}, "b&1": {"empty": ""}, "c": {"labels": ":City"}}
    rels = sorted((e.get("source"), e.get("target"), e.get("label"), tuple(data(e).items())) for e in root.iter(f"{space}edge"))
    assert rels == [("a", "a", "LIKES<>", (("x�", "�"),)), ("a", "b&1", "KNOWS", (("since", "1999"),)), ("b&1", "c", "", ())]
    keys = [k.get("id") for k in root.iter(f"{space}key")]
    assert len(keys) == len(set(keys)) and {"name", "since", "labels"} <= set(keys)


def test_graphml_is_read_back(spark, tmp_path):
    path = str(tmp_path / "g.graphml")
    graphs.write_graphml(*_tables(spark), path)
    nodes, rels = graphs.read_graphml(spark, path)
    found = {r["id"]: r["properties"] for r in nodes.collect()}
    assert set(found) == {"a", "b&1", "c"} and found["a"] == {"name": 'Zoë & "Al" <x>', "labels": ":Person:Cook", "note": NODES[0][2]["note"]} and found["b&1"] == {"empty": ""}
    assert {(r["src"], r["dst"], r["properties"].get("since")) for r in rels.collect()} == {("a", "b&1", "1999"), ("b&1", "c", None), ("a", "a", None)}
    empty = [t.where("false") for t in _tables(spark)]
    graphs.write_graphml(*empty, f"{path}2")
    assert ET.fromstring("".join(open(p).read() for p in sorted(glob.glob(f"{path}2/part-*")))) is not None


SCHEMA = "key string, n int, tags array<string>, place struct<city:string, geo:struct<x:double, y:double>>, items array<struct<sku:string, parts array<struct<w:int>>>>"
DOCS = [
    ("k1", 1, ["a", None], ("Rome", (1.0, 2.0)), [("s1", [(1,), (2,)]), None, ("s2", [])]),
    ("k2", None, None, None, []),
    ("k3", 3, [], ("Oslo", None), None),
    ("k4", 4, ["z"], (None, (None, None)), [(None, None), ("s3", [None, (7,)])]),
]


@pytest.mark.parametrize("key", ["key", None])
def test_documents_there_and_back(spark, key):
    docs = spark.createDataFrame(DOCS, SCHEMA.replace("parts array", "parts:array"))
    graph = documents.from_documents(docs, "Order", key)
    assert set(graph.labels) == {"Order", "Order_place", "Order_place_geo", "Order_items", "Order_items_parts"}
    assert {t: (r.source, r.target) for t, r in graph.types.items()}["ORDER_ITEMS_PARTS"] == ("Order_items", "Order_items_parts")
    back = documents.to_documents(graph, docs.schema, "Order")
    assert back.schema.simpleString() == StructType(docs.schema.fields).simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    if key:
        ids = {r["id"] for r in graph.nodes("Order_items").collect()}
        assert ids == {"Order/k1/items/0", "Order/k1/items/2", "Order/k4/items/0", "Order/k4/items/1"}
        again = documents.from_documents(docs.union(docs).union(docs.limit(1).selectExpr("null as key", *docs.columns[1:])), "Order", key)
        assert again.nodes("Order").count() == 4
    ends = graph.rels("ORDER_ITEMS").join(graph.nodes("Order_items").withColumnRenamed("id", "dst"), "dst", "left_anti")
    assert ends.count() == 0
