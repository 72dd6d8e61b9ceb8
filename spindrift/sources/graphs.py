"""Graphs: JSON export and import, GraphML, and the benchmark tables as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.graph import Graph, Relationships
from spindrift.operators.iterate import dealt

#: Lines of orders that one task pairs.
ROWS_A_TASK = 400_000

_NODE = "id string, labels array<string>, properties map<string,string>"
_REL = "id string, type string, startNode string, endNode string, start struct<id:string>, end struct<id:string>, properties map<string,string>"


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The benchmark tables as customers, orders, parts, suppliers, nations and
    regions with their relationships.  Everything stays lazy over the files."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    node = lambda name, key: t(name).withColumn("id", F.col(key).cast("long"))
    item = t("lineitem")
    labels = {
        "Customer": node("customer", "c_custkey"), "Order": node("orders", "o_orderkey"), "Part": node("part", "p_partkey"),
        "Supplier": node("supplier", "s_suppkey"), "Nation": node("nation", "n_nationkey"), "Region": node("region", "r_regionkey"),
        "Event": node("events", "event_id"), "Document": node("documents", "doc_id"),
    }
    ends = lambda df, a, b, *rest: df.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"), *rest)
    types = {
        "PLACED": Relationships(ends(t("orders"), "o_custkey", "o_orderkey"), "Customer", "Order"),
        "CONTAINS": Relationships(ends(item, "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"), "Order", "Part"),
        "SUPPLIES": Relationships(ends(item, "l_suppkey", "l_partkey").distinct(), "Supplier", "Part"),
        "CUSTOMER_IN": Relationships(ends(t("customer"), "c_custkey", "c_nationkey"), "Customer", "Nation"),
        "SUPPLIER_IN": Relationships(ends(t("supplier"), "s_suppkey", "s_nationkey"), "Supplier", "Nation"),
        "IN_REGION": Relationships(ends(t("nation"), "n_nationkey", "n_regionkey"), "Nation", "Region"),
        "DID": Relationships(ends(t("events"), "user_id", "event_id", "ts", "event_type", "value"), None, "Event"),
    }
    return Graph(spark, labels, types)


def bought_together(graph: Graph) -> DataFrame:
    """``src`` < ``dst``: parts of one order (orders have a bounded number of lines)."""
    lines = graph.rels("CONTAINS").select("src", "dst")
    # Dealt by order once: what follows, up to the pairs, needs no other shuffle.
    c = lines.repartition(dealt(lines, ROWS_A_TASK), "src").distinct()
    pairs = c.alias("a").join(c.alias("b"), "src").where("a.dst < b.dst")
    return pairs.select(F.col("a.dst").alias("src"), F.col("b.dst").alias("dst")).repartition(dealt(lines, ROWS_A_TASK // 2), "src", "dst").distinct()


def read_json(spark: SparkSession, nodes_path: str, relationships_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``labels``, ``properties``) and relationships (``src``,
    ``dst``, ``type``, ``properties``) of JSON lines, ends given either way."""
    nodes = spark.read.schema(_NODE).json(nodes_path)
    rels = spark.read.schema(_REL).json(relationships_path)
    return nodes, rels.select("id", "type", F.coalesce("startNode", "start.id").alias("src"), F.coalesce("endNode", "end.id").alias("dst"), "properties")


def from_tables(spark: SparkSession, nodes: DataFrame, rels: DataFrame) -> Graph:
    """A typed graph of generic tables: labels and types are few, so a table is
    made for each; properties stay a map."""
    names = [r[0] for r in nodes.select(F.explode("labels").alias("l")).distinct().collect()]  # labels, not nodes
    types = [r[0] for r in rels.select("type").distinct().collect()]
    return Graph(spark, {n: nodes.where(F.array_contains("labels", n)).select("id", "properties") for n in names},
                 {t: Relationships(rels.where(F.col("type") == t).select("src", "dst", "properties")) for t in types})


def write_json(nodes: DataFrame, rels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nodes.write.mode(mode).json(f"{path}/nodes")
    rels.select("type", F.col("src").alias("startNode"), F.col("dst").alias("endNode"), "properties").write.mode(mode).json(f"{path}/relationships")


def to_tables(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """A typed graph as generic tables (ids are prefixed by label)."""
    nodes = rels = None
    strings = lambda t, skip: F.map_filter(F.create_map(*(x for c in t.columns if c not in skip for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if set(t.columns) - set(skip) else F.create_map().cast("map<string,string>")
    for label, t in graph.labels.items():
        part = t.select(F.concat(F.lit(f"{label}/"), F.col("id").cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), strings(t, ("id",)).alias("properties"))
        nodes = part if nodes is None else nodes.union(part)
    for type_, r in graph.types.items():
        end = lambda c, label: F.concat(F.lit(f"{label}/"), F.col(c).cast("string"))
        part = r.table.select(F.lit(type_).alias("type"), end("src", r.source).alias("src"), end("dst", r.target).alias("dst"), strings(r.table, ("src", "dst")).alias("properties"))
        rels = part if rels is None else rels.union(part)
    return nodes, rels


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``properties``) and relationships (``src``, ``dst``, ``type``,
    ``properties``) of a GraphML document, in one file or in parts that join to one.

    Elements are found by their tags wherever they stand, so a part needs no root.
    """
    data = "array<struct<_key:string,_VALUE:string>>"
    props = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], F.coalesce(d["_VALUE"], F.lit("")))))
    rows = lambda tag, columns: spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", "true").option("ignoreSurroundingSpaces", "false").schema(f"{columns}, data {data}").load(path)
    nodes = rows("node", "_id string").where("_id is not null").select(F.col("_id").alias("id"), props.alias("properties"))
    rels = rows("edge", "_source string, _target string, _label string").where("_source is not null and _target is not null")
    return nodes, rels.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_label").alias("type"), props.alias("properties"))


#: Signs that a document can't hold as they are, and what stands for them (fixed values).
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"))
#: Signs that XML 1.0 has no form for.
_FORBIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def _escaped(text: Column) -> Column:
    text = F.regexp_replace(text, _FORBIDDEN, "�")
    for sign, entity in _ENTITIES:
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _properties_xml(properties: Column) -> Column:
    """``<data>`` elements in order of keys; a null value has none."""
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit('<data key="'), _escaped(e["key"]), F.lit('">'), _escaped(e["value"]), F.lit("</data>"))), "")


def write_graphml(nodes: DataFrame, rels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nodes (``id``, ``labels``, ``properties``) and relationships (``src``, ``dst``,
    ``type``, ``properties``) as one GraphML document in parts.

    Every task writes its rows, a line for each; the first part holds the header
    and the keys, the last the footer, so the parts joined in order of their names
    are one document.  Labels are the data key ``labels``, joined by colons; signs
    that XML can't hold become U+FFFD, and rows without an id or an end are left
    out.  Property names are gathered once; there are few.
    """
    spark = nodes.sparkSession
    labelled = F.map_concat(F.coalesce("properties", F.create_map().cast("map<string,string>")), F.map_filter(F.create_map(F.lit("labels"), F.concat(F.lit(":"), F.array_join("labels", ":"))), lambda _, v: v != ":"))
    nodes = nodes.where("id is not null").select("id", labelled.alias("properties"))
    rels = rels.where("src is not null and dst is not null")
    keys = nodes.select("properties").union(rels.select("properties")).select(F.explode(F.map_keys("properties")).alias("name")).distinct().orderBy("name")
    quoted = lambda c: _escaped(F.col(c).cast("string"))
    head = spark.createDataFrame([('<?xml version="1.0" encoding="UTF-8"?>',), ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',)], "value string").coalesce(1)
    declared = keys.coalesce(1).select(F.concat(F.lit('<key id="'), _escaped(F.col("name")), F.lit('" for="all" attr.name="'), _escaped(F.col("name")), F.lit('" attr.type="string"/>')).alias("value"))
    begin = spark.createDataFrame([('<graph id="G" edgedefault="directed">',)], "value string").coalesce(1)
    node = nodes.select(F.concat(F.lit('<node id="'), quoted("id"), F.lit('">'), _properties_xml(F.col("properties")), F.lit("</node>")).alias("value"))
    edge = rels.select(F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("dst"), F.lit('" label="'), F.coalesce(quoted("type"), F.lit("")), F.lit('">'), _properties_xml(F.col("properties")), F.lit("</edge>")).alias("value"))
    end = spark.createDataFrame([("</graph>",), ("</graphml>",)], "value string").coalesce(1)
    # A union keeps the order of its parts, and files are named by it.
    head.union(declared).union(begin).union(node).union(edge).union(end).write.mode(mode).text(path)
