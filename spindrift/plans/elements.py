"""Nodes, relationships, what lies around them, and changes of a graph's shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import merge, node, rel
from spindrift.functions import search as where
from spindrift.operators import neighborhood, refactor, search
from spindrift.plans import query
from spindrift.sources.graphs import tpch_graph


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark, sf_dir):
    properties = F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.struct(F.col("c_custkey").alias("id"), F.array(F.lit("Party"), F.col("c_mktsegment")).alias("labels"), properties.alias("properties")).alias("n"))


@query("""
SELECT c_custkey AS id, ['Party', c_mktsegment] AS labels, c_name AS name, c_mktsegment = 'BUILDING' AS building, c_mktsegment = 'BUILDING' AS both, NULL::VARCHAR AS absent,
  CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'none' END AS debt, ['nation'] AS kept, ['Party', c_mktsegment, 'Client'] AS more, [c_mktsegment] AS fewer, c_custkey + 1000 AS copy,
  ['debt'] AS added, ['name'] AS removed, CASE WHEN c_nationkey = 7 THEN [] ELSE ['nation'] END AS changed, FALSE AS equal, TRUE AS itself, c_custkey::VARCHAR AS text_id, c_name AS name_back
FROM customer
""")
def node_functions(spark, sf_dir):
    debt = F.when(F.col("c_acctbal") < 0, "debt").otherwise("none")
    other = node.set_property(node.set_property(node.remove_property("n", "name"), "debt", "x"), "nation", "7")
    d = node.diff("n", "m")
    back = node.from_map(node.to_map("n"))
    return _customers(spark, sf_dir).withColumn("m", other).select(
        node.id_("n").alias("id"), node.labels("n").alias("labels"), node.property_("n", "name").alias("name"), node.has_label("n", "BUILDING").alias("building"), node.has_labels("n", ["Party", "BUILDING"]).alias("both"),
        node.property_("n", "nothing").alias("absent"), node.property_(node.set_property("n", "debt", debt), "debt").alias("debt"), F.map_keys(node.properties(node.remove_properties("n", ["name", "x"]))).alias("kept"),
        node.labels(node.add_label("n", "Client")).alias("more"), node.labels(node.remove_labels("n", ["Party"])).alias("fewer"), node.id_(node.clone("n", F.col("c_custkey") + 1000)).alias("copy"),
        F.map_keys(d["added"]).alias("added"), F.map_keys(d["removed"]).alias("removed"), F.map_keys(d["changed"]).alias("changed"), node.equals("n", "m").alias("equal"), node.equals("n", "n").alias("itself"),
        node.id_(back).alias("text_id"), node.property_(back, "name").alias("name_back"))


@query("""
SELECT o_orderkey AS id, 'PLACED' AS type, o_custkey AS src, o_orderkey AS dst, [o_custkey, o_orderkey] AS nodes, o_totalprice AS price, 1.5::DOUBLE AS fallback, TRUE AS placed, FALSE AS other_type, TRUE AS has_price, FALSE AS has_both,
  CASE WHEN o_custkey = 10 THEN 'OUTGOING' WHEN o_orderkey = 10 THEN 'INCOMING' ELSE 'NONE' END AS direction, CASE WHEN o_custkey = 10 THEN o_orderkey WHEN o_orderkey = 10 THEN o_custkey END AS other,
  o_custkey = o_orderkey AS loop, o_orderkey AS back_src, (o_custkey = 10 AND o_orderkey = 7) OR (o_custkey = 7 AND o_orderkey = 10) AS between_them, o_custkey = 10 AND o_orderkey = 7 AS directed,
  o_orderkey + 1 AS copy, o_custkey = o_orderkey AS same, 'x' AS note, []::VARCHAR[] AS none, TRUE AS itself, o_custkey::VARCHAR AS src_text
FROM orders
""")
def rel_functions(spark, sf_dir):
    key, cust = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    r = F.struct(key.alias("id"), F.lit("PLACED").alias("type"), cust.alias("src"), key.alias("dst"), F.create_map(F.lit("price"), F.col("o_totalprice").cast("string")).alias("properties"))
    noted = rel.set_property("r", "note", "x")
    return _t(spark, sf_dir, "orders").select(r.alias("r")).select(
        rel.id_("r").alias("id"), rel.type_("r").alias("type"), rel.start_node("r").alias("src"), rel.end_node("r").alias("dst"), rel.nodes("r").alias("nodes"), rel.weight("r", "price").alias("price"),
        rel.weight("r", "nothing", 1.5).alias("fallback"), rel.is_any_type("r", ["PLACED", "X"]).alias("placed"), rel.is_type("r", "X").alias("other_type"), rel.has_property("r", "price").alias("has_price"),
        rel.has_properties("r", ["price", "x"]).alias("has_both"), rel.direction("r", 10).alias("direction"), rel.other_node("r", 10).alias("other"), rel.is_loop("r").alias("loop"),
        rel.start_node(rel.reverse("r")).alias("back_src"), rel.is_between("r", 10, 7).alias("between_them"), rel.is_directed_between("r", 10, 7).alias("directed"), rel.id_(rel.clone("r", rel.id_("r") + 1)).alias("copy"),
        rel.compare("r", rel.reverse("r"))["same"].alias("same"), rel.property_(noted, "note").alias("note"), F.map_keys(rel.properties(rel.remove_properties(noted, ["price", "note"]))).alias("none"),
        rel.equals("r", "r").alias("itself"), rel.start_node(rel.from_map(rel.to_map("r"))).alias("src_text"))


@query("""
SELECT c_custkey AS id, 'new' AS overwritten, c_name AS kept, c_name || '/new' AS resolved, CASE WHEN c_acctbal < 0 THEN 'new' ELSE c_name END AS conditional, ['Party', c_mktsegment, 'X'] AS labels,
  c_name AS before, 'new' AS after, ['a', 'b', 'c'] AS deep, c_name AS deep_b
FROM customer
""")
def merge_functions(spark, sf_dir):
    more = F.create_map(F.lit("name"), F.lit("new"), F.lit("extra"), F.lit("1"))
    name = lambda n: node.property_(n, "name")
    shown = merge.preview("n", more)
    inner = lambda *kv: F.create_map(F.lit("k"), F.create_map(*kv))
    deep = merge.deep_merge(inner(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), inner(F.lit("b"), name("n"), F.lit("c"), F.lit("3")))["k"]
    return _customers(spark, sf_dir).select(
        node.id_("n").alias("id"), name(merge.strategy("n", more, "overwrite")).alias("overwritten"), name(merge.strategy("n", more, "keep")).alias("kept"),
        name(merge.conflict("n", more, lambda x, y: F.concat(x, F.lit("/"), y))).alias("resolved"), name(merge.conditional("n", F.col("c_acctbal") < 0, more)).alias("conditional"),
        node.labels(merge.labels("n", ["X", "Party"])).alias("labels"), name(shown["before"]).alias("before"), name(shown["after"]).alias("after"), F.array_sort(F.map_keys(deep)).alias("deep"), deep["b"].alias("deep_b"))


@query("""
SELECT p_partkey AS id, p_name LIKE 'a%' AS begins, p_type LIKE '%STEEL' AS ends, contains(p_type, 'BRASS') AS holds, regexp_matches(p_brand, '^Brand#[12]') AS pattern, p_size IN (1, 2, 3) AS listed,
  p_size NOT IN (1, 2, 3) AS unlisted, p_name IS NOT NULL AS present, p_name IS NULL AS missing, p_size = 5 AND p_brand = 'Brand#12' AS every, p_size = 5 OR p_brand = 'Brand#12' AS some, p_type LIKE 'S%L' AS fits
FROM part
""")
def search_functions(spark, sf_dir):
    wanted = {"p_size": 5, "p_brand": "Brand#12"}
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), where.prefix("p_name", "a").alias("begins"), where.suffix("p_type", "STEEL").alias("ends"), where.contains("p_type", "BRASS").alias("holds"), where.regex("p_brand", "^Brand#[12]").alias("pattern"),
        where.in_("p_size", [1, 2, 3]).alias("listed"), where.not_in("p_size", [1, 2, 3]).alias("unlisted"), where.exists("p_name").alias("present"), where.missing("p_name").alias("missing"),
        where.node_all(wanted).alias("every"), where.node_any(wanted).alias("some"), where.match("p_type", "S*L").alias("fits"))


@query("SELECT DISTINCT p_brand AS suggestion, levenshtein(p_brand, 'Brand#1')::INTEGER AS distance FROM part WHERE levenshtein(p_brand, 'Brand#1') <= 2")
def did_you_mean(spark, sf_dir):
    return search.did_you_mean(_t(spark, sf_dir, "part"), "p_brand", "Brand#1")


@query("""
SELECT c_custkey::VARCHAR AS id, 'Customer' AS label FROM customer WHERE c_nationkey = 3 UNION ALL SELECT s_suppkey::VARCHAR, 'Supplier' FROM supplier WHERE s_nationkey = 3
""")
def multi_search(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    return search.multi_search(g, ["Customer", "Supplier"], lambda t: F.col("c_nationkey" if "c_nationkey" in t.columns else "s_nationkey") == 3)


def _typed(spark, sf_dir):
    """Orders between customers and parts, ids marked by their kind."""
    mark = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    placed = _t(spark, sf_dir, "orders").select(mark("c", "o_custkey").alias("src"), mark("o", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"))
    return placed.unionAll(_t(spark, sf_dir, "lineitem").select(mark("o", "l_orderkey").alias("src"), mark("p", "l_partkey").alias("dst"), F.lit("CONTAINS").alias("type")))


_TYPED = """r AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS' FROM lineitem),
 b AS (SELECT src AS id, dst AS other, type FROM r UNION ALL SELECT dst, src, type FROM r)"""


@query(f"""
WITH {_TYPED} SELECT id, list_sort(list(DISTINCT type)) AS types, (SELECT list_sort(list(DISTINCT type)) FROM r WHERE src = id) AS types_out, (SELECT list_sort(list(DISTINCT type)) FROM r WHERE dst = id) AS types_in,
  count(DISTINCT other) AS neighbors, CASE WHEN count(*) > 20 THEN count(*) END AS dense FROM b GROUP BY id
""")
def node_relationships(spark, sf_dir):
    return neighborhood.summaries(_typed(spark, sf_dir), 20)


@query("""
SELECT s_suppkey AS a, s_suppkey + 1 AS b, EXISTS (SELECT 1 FROM lineitem WHERE (l_suppkey = s_suppkey AND l_partkey = s_suppkey + 1) OR (l_suppkey = s_suppkey + 1 AND l_partkey = s_suppkey)) AS connected,
  EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey) AS supplies FROM supplier
""")
def node_connected(spark, sf_dir):
    rels = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"), F.lit("SUPPLIES").alias("type"))
    a = F.col("s_suppkey").cast("long")
    pairs = neighborhood.connected(_t(spark, sf_dir, "supplier").select(a.alias("a"), (a + 1).alias("b")), rels)
    return neighborhood.relationship_exists(pairs.withColumn("id", F.col("a")), rels, "out", ["SUPPLIES"]).select("a", "b", "connected", F.col("exists").alias("supplies"))


@query("""
WITH x AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), y AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'union' AS kind, id FROM (SELECT id FROM x UNION SELECT id FROM y) UNION ALL SELECT 'intersect', id FROM (SELECT id FROM x INTERSECT SELECT id FROM y) UNION ALL SELECT 'difference', id FROM (SELECT id FROM x EXCEPT SELECT id FROM y)
""")
def node_sets(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    x, y = c.where("c_acctbal < 0"), c.where("c_mktsegment = 'BUILDING'")
    kinds = {"union": neighborhood.union, "intersect": neighborhood.intersect, "difference": neighborhood.difference}
    one, two, three = (f(x, y).select(F.lit(k).alias("kind"), "id") for k, f in kinds.items())
    return one.unionAll(two).unionAll(three)


@query("""
WITH n AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey < 3), r AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey),
p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM r WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) AND src <> dst)
SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM p) AS linked, round(2.0 * (SELECT count(*) FROM p) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 6) AS density
""")
def node_density(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"))
    rels = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "customer"), F.expr("s_suppkey = c_custkey")).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return neighborhood.density(nations, rels).withColumn("density", F.round("density", 6))


@query("""
SELECT o_custkey AS customer, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS src, 'HISTORY' AS type, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS dst, count(*) - 2 AS between_them FROM orders GROUP BY o_custkey HAVING count(*) > 1
""")
def collapsed_chains(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return neighborhood.collapsed(o, "customer", "o_orderdate", "HISTORY").withColumnRenamed("between", "between_them")


@query("""
SELECT l_orderkey AS src, l_partkey AS dst, min(l_linenumber)::INTEGER AS line, arg_min(l_quantity, (l_linenumber, l_quantity)) AS quantity, arg_min(l_discount, (l_linenumber, l_discount)) AS discount FROM lineitem GROUP BY l_orderkey, l_partkey
""")
def merged_relationships(spark, sf_dir):
    rels = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return refactor.merge_relationships(rels, "line")


@query("""
WITH gone AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000)
SELECT 'bypass' AS kind, o_custkey AS src, l_partkey AS dst FROM gone JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'placed', o_custkey, o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, FALSE)
""")
def deleted_and_reconnected(spark, sf_dir):
    """Large orders go; their customers keep the parts."""
    g = tpch_graph(spark, sf_dir)
    large = g.nodes("Order").where("o_totalprice > 100000")
    g = refactor.delete_and_reconnect(g, "Order", large, "PLACED", "CONTAINS", "BOUGHT")
    kind = lambda k, t: t.select(F.lit(k).alias("kind"), "src", "dst")
    return kind("bypass", g.rels("BOUGHT")).unionAll(kind("placed", g.rels("PLACED")))


@query("""
SELECT 'inverted' AS kind, n_nationkey AS src, c_custkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL
SELECT 'large', l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'small', l_orderkey, l_partkey FROM lineitem WHERE NOT coalesce(l_quantity > 40, FALSE) UNION ALL
SELECT 'placing', o_custkey, o_orderkey + 1000000 FROM orders UNION ALL SELECT 'placed', o_orderkey + 1000000, o_orderkey FROM orders
""")
def reshaped(spark, sf_dir):
    """Inverted, retyped and extracted relationships of renamed types."""
    g = refactor.invert(tpch_graph(spark, sf_dir), "CUSTOMER_IN")
    g = refactor.rename_type(refactor.change_type(g, "CONTAINS", F.col("l_quantity") > 40, "LARGE"), "CONTAINS", "SMALL")
    g = refactor.extract_nodes(g, "PLACED", "Placing", F.col("dst") + 1000000, "PLACING", "PLACED_AS")
    kind = lambda k, t: g.rels(t).select(F.lit(k).alias("kind"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    parts = [kind(*x) for x in (("inverted", "CUSTOMER_IN"), ("large", "LARGE"), ("small", "SMALL"), ("placing", "PLACING"), ("placed", "PLACED_AS"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query("""
SELECT p_partkey AS id, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 40 THEN 'middle' END AS class, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN TRUE WHEN p_brand = 'Brand#13' THEN FALSE END AS flag FROM part
""")
def categorized(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), refactor.categorized(F.col("p_size"), [(1, 10, "small"), (10, 40, "middle")]).alias("class"), refactor.as_boolean(F.col("p_brand"), ["Brand#11", "Brand#12"], ["Brand#13"]).alias("flag"))
