"""Graph algorithms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import algorithms, inference, links
from spindrift.plans import query
from spindrift.plans.patterns import _NEXT, _TOGETHER, next_orders
from spindrift.sources.graphs import bought_together, tpch_graph


def _parts(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    return g.nodes("Part").select("id"), bought_together(g)


def _page_rank_sql(rounds: int = 20) -> str:
    """The rounds as one common table after another."""
    sql = """WITH n AS (SELECT count(*) AS n FROM nation), trade AS (
      SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND c_nationkey <> s_nationkey
    ), k AS (SELECT src, count(*) AS k FROM trade GROUP BY src), r0 AS (SELECT n_nationkey::BIGINT AS id, 1.0::DOUBLE / n AS s FROM nation, n)"""
    for i in range(rounds):
        sql += f""", r{i + 1} AS MATERIALIZED (SELECT r.id, (0.15 / n + 0.85 * (coalesce(g.g, 0) + (SELECT coalesce(sum(s), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM k)) / n))::DOUBLE AS s
          FROM r{i} r CROSS JOIN n LEFT JOIN (SELECT dst, sum(s / k) AS g FROM trade JOIN k USING (src) JOIN r{i} x ON x.id = src GROUP BY dst) g ON g.dst = r.id)"""
    return sql + f" SELECT id, round(s, 8) AS score FROM r{rounds}"


@query(_page_rank_sql())
def page_rank(spark, sf_dir):
    """Of nations, by who buys large lots from whom."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").where("l_quantity >= 50").select("l_orderkey", "l_suppkey")
    sold = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).join(lines, F.expr("l_orderkey = o_orderkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    e = sold.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).where("src <> dst").distinct()
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return algorithms.page_rank(nodes, e).select("id", F.round("score", 8).alias("score"))


@query(_NEXT + "SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def weak_components(spark, sf_dir):
    """Of the chains of each customer's orders."""
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return algorithms.components(nodes, next_orders(spark, sf_dir))


@query(_TOGETHER + """
, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON c.src = a.src AND c.dst = b.dst),
each AS (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t), n AS (SELECT id, count(*) AS triangles FROM each GROUP BY id),
d AS (SELECT src AS id, count(*) AS d FROM e GROUP BY src)
SELECT p_partkey AS id, coalesce(triangles, 0) AS triangles, round(coalesce(2.0 * triangles / nullif(d * (d - 1), 0), 0), 6) AS coefficient
FROM part LEFT JOIN n ON n.id = p_partkey LEFT JOIN d ON d.id = p_partkey
""")
def clustering_coefficients(spark, sf_dir):
    nodes, e = _parts(spark, sf_dir)
    return algorithms.clustering(nodes, e).withColumn("coefficient", F.round("coefficient", 6))


@query(_TOGETHER + """
SELECT p_partkey AS id, count(*) FILTER (dst = p_partkey) AS in_degree, count(*) FILTER (src = p_partkey) AS out_degree, count(src) AS degree
FROM part LEFT JOIN pairs ON p_partkey = src OR p_partkey = dst GROUP BY p_partkey
""")
def degrees(spark, sf_dir):
    return algorithms.degrees(*_parts(spark, sf_dir))


@query(_TOGETHER + "SELECT round(count(*) * 2.0 / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - 1)), 8) AS density FROM pairs")
def density(spark, sf_dir):
    return algorithms.density(*_parts(spark, sf_dir)).select(F.round("density", 8).alias("density"))


@query(_TOGETHER + """
, c AS (SELECT p_partkey AS id, p_brand AS community FROM part),
x AS (SELECT a.community AS a, b.community AS b FROM pairs JOIN c a ON src = a.id JOIN c b ON dst = b.id),
k AS (SELECT a, count(*) AS k FROM (SELECT a FROM x UNION ALL SELECT b FROM x) GROUP BY a), i AS (SELECT a, count(*) AS n FROM x WHERE a = b GROUP BY a), m AS (SELECT count(*) AS m FROM x)
SELECT round(sum(coalesce(n, 0) / m - (k / (2.0 * m)) * (k / (2.0 * m))), 8) AS modularity FROM k LEFT JOIN i USING (a) CROSS JOIN m
""")
def modularity(spark, sf_dir):
    """Of brands as communities of parts bought together."""
    _, e = _parts(spark, sf_dir)
    brand = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return algorithms.modularity(e, brand).select(F.round("modularity", 8).alias("modularity"))


@query(_TOGETHER.replace("WITH pairs", "WITH RECURSIVE pairs") + """
, c(id, core) USING KEY (id) AS (
  SELECT p_partkey AS id, count(e.src) AS core FROM part LEFT JOIN e ON e.src = p_partkey GROUP BY p_partkey
  UNION
  (SELECT n.id, n.h FROM (
     SELECT id, max(least(core, place)) AS h FROM (
       SELECT e.src AS id, r.core, row_number() OVER (PARTITION BY e.src ORDER BY r.core DESC) AS place FROM e JOIN recurring.c r ON r.id = e.dst
       WHERE e.src IN (SELECT e.dst FROM c JOIN e ON e.src = c.id)) GROUP BY id) n
   JOIN recurring.c o ON o.id = n.id WHERE n.h < o.core)
)
SELECT id, core FROM c
""")
def core_numbers(spark, sf_dir):
    return algorithms.core_numbers(*_parts(spark, sf_dir))


def _labels_sql(rounds: int = 20) -> str:
    """The rounds as one common table after another; after the last change they repeat."""
    sql = _TOGETHER + ", l0 AS (SELECT p_partkey AS id, p_partkey AS community FROM part)"
    for i in range(rounds):
        sql += f""", l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.community, l.community) AS community FROM l{i} l LEFT JOIN (
          SELECT dst, arg_min(community, (-n, community)) AS community FROM (SELECT dst, community, count(*) AS n FROM e JOIN l{i} x ON x.id = src GROUP BY dst, community) GROUP BY dst) b ON b.dst = l.id)"""
    return sql + f" SELECT id, community FROM l{rounds}"


@query(_labels_sql())
def label_propagation(spark, sf_dir):
    return algorithms.label_propagation(*_parts(spark, sf_dir))


@query()
def louvain(spark, sf_dir):
    return algorithms.louvain(*_parts(spark, sf_dir))


@query()
def fast_rp(spark, sf_dir):
    nodes, e = _parts(spark, sf_dir)
    return algorithms.fast_rp(nodes, e, dimension=16)


def _nation_trade(spark, sf_dir):
    """Nations linked by the customer and supplier of one number: a sparse graph."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    e = t("supplier").join(t("customer"), F.expr("s_suppkey = c_custkey")).select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).where("src <> dst").distinct()
    return t("nation").select(F.col("n_nationkey").cast("long").alias("id")), e


_SPARSE = """
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey),
v AS (SELECT n_nationkey::BIGINT AS id FROM nation)"""
_HOPS = """
, d(s, id, hop) USING KEY (s, id) AS (
  SELECT id AS s, id, 0 AS hop FROM v
  UNION
  (SELECT DISTINCT d.s, g.dst, d.hop + 1 FROM d JOIN {0} g ON g.src = d.id LEFT JOIN recurring.d o ON o.s = d.s AND o.id = g.dst WHERE o.id IS NULL)
)"""


@query(_SPARSE + _HOPS.format("e") + """
, p AS (
  SELECT id AS s, id, 0 AS hop, 1.0::DOUBLE AS paths FROM v
  UNION ALL
  (SELECT p.s, e.dst, p.hop + 1, sum(p.paths) FROM p JOIN e ON e.src = p.id JOIN d ON d.s = p.s AND d.id = e.dst AND d.hop = p.hop + 1 GROUP BY p.s, e.dst, p.hop)
), between AS (
  SELECT a.id, sum(a.paths * b.paths / c.paths) AS score FROM p a JOIN p b ON b.s = a.id JOIN p c ON c.s = a.s AND c.id = b.id AND c.hop = a.hop + b.hop
  WHERE a.id <> a.s AND a.id <> b.id GROUP BY a.id
)
SELECT id, round(coalesce(score, 0) * 2 / ((SELECT count(*) - 1 FROM v) * (SELECT count(*) - 2 FROM v)), 6) AS score FROM v LEFT JOIN between USING (id)
""")
def betweenness(spark, sf_dir):
    return algorithms.betweenness(*_nation_trade(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_SPARSE + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)" + _HOPS.format("u") + """
SELECT v.id, round(coalesce(count(d.id)::DOUBLE * count(d.id) / (sum(hop) * (SELECT count(*) - 1 FROM v)), 0), 6) AS score FROM v LEFT JOIN d ON d.s = v.id AND hop > 0 GROUP BY v.id
""")
def closeness(spark, sf_dir):
    return algorithms.closeness(*_nation_trade(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_TOGETHER.replace("WITH pairs", "WITH RECURSIVE pairs") + """
, v AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 500 = 7)""" + _HOPS.format("e") + """
SELECT v.id, round(coalesce(count(d.id)::DOUBLE * count(d.id) / (sum(hop) * (SELECT count(*) - 1 FROM part)), 0), 6) AS score FROM v LEFT JOIN d ON d.s = v.id AND hop > 0 GROUP BY v.id
""")
def closeness_of_parts(spark, sf_dir):
    """Of a stated set, one of every five hundred parts, over all parts bought together."""
    nodes, e = _parts(spark, sf_dir)
    return algorithms.closeness(nodes, e, sources=nodes.where("id % 500 = 7")).withColumn("score", F.round("score", 6))


@query(_SPARSE + _HOPS.format("e") + "SELECT a.s AS id, min(a.id) AS component FROM d a JOIN d b ON b.s = a.id AND b.id = a.s GROUP BY a.s")
def strong_components(spark, sf_dir):
    return algorithms.strong_components(*_nation_trade(spark, sf_dir))


_TRADE = """
WITH e0 AS (SELECT DISTINCT c_nationkey::BIGINT AS s, s_nationkey::BIGINT AS d FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey),
e AS (SELECT s AS src, d AS dst FROM e0 UNION SELECT d, s FROM e0), g AS (SELECT src AS id, count(*) AS g FROM e GROUP BY src)
"""


@query(_TRADE + """
, two AS (SELECT x.src AS a, y.dst AS b, g.g AS g FROM e x JOIN e y ON x.dst = y.src JOIN g ON g.id = x.dst WHERE x.src <> y.dst),
p AS (SELECT a, b, count(*) AS common_neighbors, sum(CASE WHEN g > 1 THEN 1 / ln(g) ELSE 0 END) AS adamic_adar, sum(1.0 / g) AS resource_allocation FROM two
      WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = a AND dst = b) GROUP BY a, b)
SELECT a, b, common_neighbors, round(adamic_adar, 6) AS adamic_adar, round(resource_allocation, 6) AS resource_allocation,
  round(common_neighbors::DOUBLE / (x.g + y.g - common_neighbors), 6) AS jaccard, x.g * y.g AS preferential_attachment
FROM p JOIN g x ON x.id = a JOIN g y ON y.id = b
""")
def link_prediction(spark, sf_dir):
    _, e = _nation_trade(spark, sf_dir)
    out = links.scores(e)
    return out.select("a", "b", "common_neighbors", *(F.round(c, 6).alias(c) for c in ("adamic_adar", "resource_allocation", "jaccard")), "preferential_attachment")


@query(_TRADE + """
, c AS (SELECT src, dst, 0.5 + 0.5 / (1 + abs(src - dst)) AS confidence FROM e),
two AS (SELECT x.src AS src, y.dst AS dst, max(x.confidence * y.confidence) AS confidence FROM c x JOIN c y ON x.dst = y.src WHERE x.src <> y.dst GROUP BY 1, 2)
SELECT src, dst, round(confidence, 6) AS confidence FROM two WHERE confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = two.src AND e.dst = two.dst)
""")
def transitive_edges(spark, sf_dir):
    _, e = _nation_trade(spark, sf_dir)
    both = e.union(e.select("dst", "src")).distinct().withColumn("confidence", 0.5 + 0.5 / (1 + F.abs(F.col("src") - F.col("dst"))))
    return inference.transitive_edges(both).withColumn("confidence", F.round("confidence", 6))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
n AS (SELECT q.vec_id AS src, v.vec_id AS dst, list_cosine_similarity(q.e, v.e) AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM n WHERE score >= 0.4)
SELECT src, dst, round(score, 6) AS score FROM r WHERE place <= 10
""")
def similarity_edges(spark, sf_dir):
    """For a stated set of queries (every fiftieth vector), against all vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return inference.similarity_edges(v.where("id % 50 = 0"), v, k=10, least=0.4).withColumn("score", F.round("score", 6))


@query("""
WITH x AS (SELECT user_id AS src, event_type AS label, value AS score, date_trunc('day', ts) AS session FROM events WHERE value IS NOT NULL)
SELECT src, label, count(*) AS n, round(sum(score), 4) AS score, count(DISTINCT session) AS sessions FROM x GROUP BY src, label
HAVING count(*) >= 3 AND sum(score) >= 0.5 AND count(DISTINCT session) >= 2
""")
def edge_evidence(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null").select(
        F.col("user_id").alias("src"), F.lit(0).alias("dst"), F.col("event_type").alias("label"), F.col("value").alias("score"), F.date_trunc("day", "ts").alias("session"))
    return inference.evidence(x).drop("dst").withColumn("score", F.round("score", 4))


@query("""
SELECT l_suppkey AS supplier, l_partkey AS part, rank::INTEGER AS rank FROM (
  SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE rank <= 5
""")
def top_parts_per_supplier(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("q"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("supplier").orderBy(F.desc("q"), "part"))).where("rank <= 5").drop("q")
