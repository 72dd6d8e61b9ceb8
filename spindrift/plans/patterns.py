"""Patterns, joins, aggregation, set operations and writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import agg, scalar
from spindrift.operators import match as m
from spindrift.operators import traverse, writes
from spindrift.operators.iterate import settled
from spindrift.plans import query
from spindrift.sources.graphs import bought_together, tpch_graph


@query("""
SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment
""")
def segment_orders(spark, sf_dir):
    """(c:Customer)-[:PLACED]->(o:Order), by segment."""
    found = m.match(tpch_graph(spark, sf_dir), "c", "Customer").out("PLACED", "o", "Order").frame()
    return found.groupBy(F.col("c.c_mktsegment").alias("segment")).agg(F.count("*").alias("orders"), F.round(F.sum("o.o_totalprice"), 2).alias("total"))


@query("""
SELECT p_partkey AS part, p_name AS name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name
ORDER BY revenue DESC, part LIMIT 10
""")
def top_products_by_revenue(spark, sf_dir):
    """Relationship properties are summed before the join with the parts."""
    g = tpch_graph(spark, sf_dir)
    revenue = m.aggregate_relationships(g, "CONTAINS", "dst", revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2))
    best = revenue.orderBy(F.desc("revenue"), "id").limit(10)
    return best.join(g.nodes("Part").select("id", F.col("p_name").alias("name")), "id").select(F.col("id").alias("part"), "name", "revenue")


@query("""
SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(avg(o_totalprice), 2) AS mean
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name
""")
def orders_by_region(spark, sf_dir):
    """A chain of three hops."""
    found = m.match(tpch_graph(spark, sf_dir), "o", "Order").in_("PLACED", "c", "Customer").out("CUSTOMER_IN", "n", "Nation").out("IN_REGION", "r", "Region").frame()
    return found.groupBy(F.col("r.r_name").alias("region"), F.col("n.n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.avg("o.o_totalprice"), 2).alias("mean"))


@query("""
SELECT c_custkey AS customer, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def optional_orders(spark, sf_dir):
    """OPTIONAL MATCH: customers without orders stay."""
    found = m.match(tpch_graph(spark, sf_dir), "c", "Customer").out("PLACED", "o", "Order", optional=True).frame()
    return found.groupBy(F.col("c.id").alias("customer")).agg(F.count("o.id").alias("orders"), F.coalesce(F.round(F.sum("o.o_totalprice"), 2), F.lit(0.0)).alias("total"))


@query("""
SELECT c_mktsegment AS segment, count(*) AS idle FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment
""")
def customers_without_orders(spark, sf_dir):
    found = m.match(tpch_graph(spark, sf_dir), "c", "Customer").exists("PLACED", negate=True).frame()
    return found.groupBy(F.col("c.c_mktsegment").alias("segment")).agg(F.count("*").alias("idle"))


@query("""
SELECT s_suppkey AS supplier FROM supplier
WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_size >= 45)
""")
def suppliers_of_large_parts(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    return m.match(g, "s", "Supplier").exists("SUPPLIES", far=g.range("Part", "p_size", low=45)).frame().select(F.col("s.id").alias("supplier"))


@query("""
SELECT c_custkey AS customer, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey HAVING count(*) > 15
""")
def busy_customers(spark, sf_dir):
    """COUNT { (c)-[:PLACED]->() } > 15."""
    found = m.match(tpch_graph(spark, sf_dir), "c", "Customer").count("PLACED", "orders").where("orders > 15").frame()
    return found.select(F.col("c.id").alias("customer"), "orders")


@query("""
WITH supplies AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT p_brand AS brand, count(*) AS customers FROM (
  SELECT DISTINCT p_brand, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey WHERE p_type LIKE '%BRASS%' OR p_size > 25
) GROUP BY p_brand
""")
def brand_customers(spark, sf_dir):
    """Filters on the far node run before its join."""
    far = lambda t: t.where(F.col("p_type").contains("BRASS") | (F.col("p_size") > 25))
    found = m.match(tpch_graph(spark, sf_dir), "c", "Customer").out("PLACED", "o", "Order").out("CONTAINS", "p", "Part", on=far).frame()
    return found.select(F.col("p.p_brand").alias("brand"), F.col("c.id").alias("c")).distinct().groupBy("brand").agg(F.count("*").alias("customers"))


@query("""
SELECT p_partkey AS part, count(l_partkey) AS lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey
""")
def incoming_counts(spark, sf_dir):
    return m.count_by_target(tpch_graph(spark, sf_dir), "CONTAINS", "Part").select(F.col("id").alias("part"), F.col("in_degree").alias("lines"))


@query("""
SELECT s_suppkey AS supplier, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey
""")
def outgoing_counts(spark, sf_dir):
    return m.count_by_source(tpch_graph(spark, sf_dir), "SUPPLIES", "Supplier").select(F.col("id").alias("supplier"), F.col("out_degree").alias("parts"))


@query("""
SELECT l_partkey AS part, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n
FROM lineitem GROUP BY l_partkey
""")
def quantity_by_part(spark, sf_dir):
    q = F.col("l_quantity")
    found = m.aggregate_relationships(tpch_graph(spark, sf_dir), "CONTAINS", "dst", total=F.round(F.sum(q), 2), mean=F.round(F.avg(q), 4), low=F.min(q), high=F.max(q), n=F.count("*"))
    return found.withColumnRenamed("id", "part")


@query("""
WITH follows AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
)
SELECT x.src AS a, x.dst AS b FROM follows x JOIN follows y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst
""")
def mutual_followers(spark, sf_dir):
    """Parts that follow each other on orders' lines, both ways."""
    g = tpch_graph(spark, sf_dir)
    line = g.rels("CONTAINS").select("src", "dst", "l_linenumber")
    follows = line.alias("x").join(line.alias("y"), F.expr("x.src = y.src and y.l_linenumber = x.l_linenumber + 1")).select(F.col("x.dst").alias("src"), F.col("y.dst").alias("dst"))
    return m.mutual(g.with_type("FOLLOWS", follows, "Part", "Part"), "FOLLOWS")


_NEXT = """
WITH next AS (
  SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst, o_custkey FROM orders
), e AS (SELECT src, dst FROM next WHERE dst IS NOT NULL)
"""


def next_orders(spark, sf_dir):
    """``src``, ``dst``: each order and its customer's next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")


@query(_NEXT + """
, walk AS (
  SELECT src AS start, dst AS id, 1 AS hops FROM e
  UNION ALL SELECT w.start, e.dst, hops + 1 FROM (SELECT src AS start, dst AS id, 1 AS hops FROM e) w JOIN e ON w.id = e.src
  UNION ALL SELECT a.src, c.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src
)
SELECT hops::INTEGER AS hops, count(*) AS paths FROM walk GROUP BY hops
""")
def variable_length(spark, sf_dir):
    """-[:NEXT*1..3]-> from every order."""
    e = next_orders(spark, sf_dir)
    starts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    found = traverse.var_length(e, starts, 1, 3)
    return found.groupBy((F.size("nodes") - 1).alias("hops")).agg(F.count("*").alias("paths"))


_TOGETHER = """
WITH pairs AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
), e AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs)
"""


@query(_TOGETHER.replace("WITH", "WITH RECURSIVE") + """
, first AS (SELECT min(src) AS s FROM e), reach AS (
  SELECT s AS id, 0 AS hop FROM first UNION SELECT e.dst, hop + 1 FROM reach JOIN e ON reach.id = e.src WHERE hop < 3
)
SELECT id, min(hop)::INTEGER AS hop FROM reach GROUP BY id HAVING min(hop) > 0
""")
def neighbors_by_hop(spark, sf_dir):
    """Parts within three hops of the least part, by hop."""
    e = traverse.both_ways(settled(bought_together(tpch_graph(spark, sf_dir)), "together"))
    start = e.agg(F.min("src").alias("id"))
    return traverse.neighbors_by_hop(e, start, 3, stored=True).select("id", "hop")


@query(_TOGETHER.replace("WITH", "WITH RECURSIVE") + """
, ends AS (SELECT min(src) AS s, max(src) AS t FROM e), reach AS (
  SELECT s AS id, 0 AS hop FROM ends UNION SELECT e.dst, hop + 1 FROM reach JOIN e ON reach.id = e.src WHERE hop < 6
)
SELECT s AS start, t AS "end", (SELECT min(hop) FROM reach WHERE id = t)::INTEGER AS hops FROM ends
""")
def shortest_path(spark, sf_dir):
    """shortestPath from the least to the greatest part."""
    e = traverse.both_ways(settled(bought_together(tpch_graph(spark, sf_dir)), "together"))
    ends = settled(e.agg(F.min("src").alias("s"), F.max("src").alias("t")), "ends")
    found = traverse.shortest_paths(e, ends.select(F.col("s").alias("id")), ends.select(F.col("t").alias("id")), high=6, stored=True)
    return found.select("start", F.col("id").alias("end"), "hops")


@query("""
WITH RECURSIVE sold AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), w AS (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, round(1e6 / count(*), 3) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey
  JOIN sold ON sold.l_partkey = l.l_partkey JOIN supplier ON s_suppkey = sold.l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL
), d(id, cost) USING KEY (id) AS (
  SELECT min(n_nationkey)::BIGINT AS id, 0.0::DOUBLE AS cost FROM nation
  UNION
  (SELECT x.id, x.cost FROM (SELECT w.dst AS id, min(d.cost + w.weight) AS cost FROM d JOIN w ON w.src = d.id GROUP BY w.dst) x LEFT JOIN recurring.d o ON o.id = x.id WHERE o.cost IS NULL OR x.cost < o.cost)
)
SELECT id, round(cost, 3) AS cost FROM d
""")
def cheapest_paths(spark, sf_dir):
    """Dijkstra's costs over price between nations that trade, from the least nation."""
    g = tpch_graph(spark, sf_dir)
    trade = (m.match(g, "o", "Order").in_("PLACED", "c", "Customer").out("CUSTOMER_IN", "n", "Nation").from_("o").out("CONTAINS", "p", "Part").in_("SUPPLIES", "s", "Supplier").out("SUPPLIER_IN", "k", "Nation").frame())
    e = trade.groupBy(F.col("n.id").alias("src"), F.col("k.id").alias("dst")).agg(F.round(1e6 / F.count("*"), 3).alias("weight")).where("src <> dst")
    start = g.nodes("Nation").agg(F.min("id").alias("id"))
    return traverse.weighted_paths(e, start).select("id", F.round("cost", 3).alias("cost"))


@query("""
SELECT c_nationkey AS nation, list_sort(list(DISTINCT c_mktsegment)) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey
""")
def collect_distinct(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(agg.collect_distinct("c_mktsegment").alias("segments"), F.count_distinct("c_mktsegment").alias("n"))


@query("""
SELECT o_orderpriority AS priority,
  count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_totalprice <= 200000 OR o_totalprice IS NULL) AS small,
  round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS deviation
FROM orders GROUP BY o_orderpriority
""")
def priority_statistics(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    large = F.col("o_totalprice") > 200000
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.when(large, 1)).alias("large"), F.count(F.when(~F.coalesce(large, F.lit(False)), 1)).alias("small"),
        F.round(agg.percentile_cont("o_totalprice", 0.5), 4).alias("median"), F.round(agg.stdev_samp("o_totalprice"), 4).alias("deviation"))


@query("""
SELECT n_name AS name, 'customer' AS kind FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION SELECT n_name, 'supplier' FROM nation JOIN supplier ON s_nationkey = n_nationkey
""")
def union_of_matches(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    part = lambda label, type_, kind: m.match(g, "x", label).out(type_, "n", "Nation").frame().select(F.col("n.n_name").alias("name"), F.lit(kind).alias("kind"))
    return part("Customer", "CUSTOMER_IN", "customer").union(part("Supplier", "SUPPLIER_IN", "supplier")).distinct()


@query("""
SELECT c_custkey AS customer, unnest(range(1, 4))::INTEGER AS k, c_custkey * unnest(range(1, 4)) AS product FROM customer
""")
def unwind_range(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("customer"))
    return m.unwind(c, scalar.range_(1, 3), "k").withColumn("product", F.col("customer") * F.col("k"))


@query("""
SELECT o_custkey AS customer, o_orderkey AS "order", place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3
""")
def top_orders_per_customer(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), place.alias("place")).where("place <= 3")


@query("""
SELECT o_orderkey AS "order", o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5
""")
def skip_and_limit(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10).select(F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price"))


@query("""
SELECT s_suppkey AS id, s_name AS name, round(CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey) THEN s_acctbal + 1 ELSE s_acctbal END, 2) AS balance, false AS made FROM supplier
UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2), true FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def merge_nodes(spark, sf_dir):
    """MERGE with ON CREATE and ON MATCH."""
    g = tpch_graph(spark, sf_dir)
    base = g.nodes("Supplier").select("id", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(False).alias("made"))
    rows = g.nodes("Customer").select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    g = writes.merge_nodes(g.with_label("Party", base), "Party", rows, ["id"], on_create={"made": F.lit(True)}, on_match={"balance": F.col("balance") + 1})
    return g.nodes("Party").withColumn("balance", F.round("balance", 2))


@query("""
SELECT c_mktsegment AS segment, count(*) AS left_over FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY c_mktsegment
""")
def detach_delete(spark, sf_dir):
    """DETACH DELETE of customers in debt: their PLACED relationships go too."""
    g = tpch_graph(spark, sf_dir)
    g = writes.delete_nodes(g, "Customer", g.range("Customer", "c_acctbal", high=0, include_high=False), detach=True)
    found = m.match(g, "c", "Customer").out("PLACED", "o", "Order").frame()
    return found.groupBy(F.col("c.c_mktsegment").alias("segment")).agg(F.count("*").alias("left_over"))


@query("""
SELECT 'node' AS kind, 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'node', 'Order', count(*) FROM orders
UNION ALL SELECT 'node', 'Part', count(*) FROM part UNION ALL SELECT 'node', 'Supplier', count(*) FROM supplier
UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Region', count(*) FROM region
UNION ALL SELECT 'node', 'Event', count(*) FROM events UNION ALL SELECT 'node', 'Document', count(*) FROM documents
UNION ALL SELECT 'relationship', 'PLACED', count(*) FROM orders UNION ALL SELECT 'relationship', 'CONTAINS', count(*) FROM lineitem
UNION ALL SELECT 'relationship', 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
UNION ALL SELECT 'relationship', 'CUSTOMER_IN', count(*) FROM customer UNION ALL SELECT 'relationship', 'SUPPLIER_IN', count(*) FROM supplier
UNION ALL SELECT 'relationship', 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'relationship', 'DID', count(*) FROM events
""")
def graph_counts(spark, sf_dir):
    return tpch_graph(spark, sf_dir).counts()


@query("""
SELECT c_name, count(*) AS n FROM customer GROUP BY c_name HAVING count(*) > 1
""")
def unique_violations(spark, sf_dir):
    return tpch_graph(spark, sf_dir).with_constraint("names", "unique", "Customer", ["c_name"]).violations("names")
