"""Schemas, patterns and figures of the benchmark graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import stats
from spindrift.operators import algorithms, inspection
from spindrift.plans import query
from spindrift.plans.patterns import _NEXT, next_orders
from spindrift.sources.graphs import tpch_graph

#: The relationships of the benchmark graph: type, labels at the ends, rows and the keys at either end.
_TYPES = {
    "PLACED": ("Customer", "Order", "SELECT o_custkey AS s, o_orderkey AS d FROM orders"),
    "CONTAINS": ("Order", "Part", "SELECT l_orderkey AS s, l_partkey AS d FROM lineitem"),
    "SUPPLIES": ("Supplier", "Part", "SELECT DISTINCT l_suppkey AS s, l_partkey AS d FROM lineitem"),
    "CUSTOMER_IN": ("Customer", "Nation", "SELECT c_custkey AS s, c_nationkey AS d FROM customer"),
    "SUPPLIER_IN": ("Supplier", "Nation", "SELECT s_suppkey AS s, s_nationkey AS d FROM supplier"),
    "IN_REGION": ("Nation", "Region", "SELECT n_nationkey AS s, n_regionkey AS d FROM nation"),
    "DID": (None, "Event", "SELECT user_id AS s, event_id AS d FROM events"),
}
_quoted = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"


@query(" UNION ALL ".join(f"SELECT {_quoted(a)} AS source, '{t}' AS type, {_quoted(b)} AS target, count(*) AS n FROM ({rows})" for t, (a, b, rows) in _TYPES.items()))
def graph_patterns(spark, sf_dir):
    return inspection.patterns(tpch_graph(spark, sf_dir))


@query("SELECT *, (CASE WHEN most_in > 1 THEN 'n' ELSE '1' END) || ':' || (CASE WHEN most_out > 1 AND most_in > 1 THEN 'm' WHEN most_out > 1 THEN 'n' ELSE '1' END) AS kind FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS type, (SELECT count(*) FROM ({rows})) AS n, (SELECT count(DISTINCT s) FROM ({rows})) AS sources, (SELECT count(DISTINCT d) FROM ({rows})) AS targets,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM ({rows}) GROUP BY s)) AS most_out, (SELECT max(n) FROM (SELECT count(*) AS n FROM ({rows}) GROUP BY d)) AS most_in"""
    for t, (_, _, rows) in _TYPES.items()) + ")")
def relationship_cardinalities(spark, sf_dir):
    return inspection.cardinalities(tpch_graph(spark, sf_dir))


_PART = ("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS property, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS different, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM part" for c in _PART))
def property_figures(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return inspection.analyze(part.select(*(c for c in _PART if c in part.columns)), exact=True).drop("type")


@query("""
SELECT 'PLACED' AS type, 'src' AS "end", o_custkey::VARCHAR AS id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
UNION ALL SELECT 'CONTAINS', 'src', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'CONTAINS', 'dst', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey
UNION ALL SELECT 'SUPPLIES', 'src', l_suppkey::VARCHAR, count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey
UNION ALL SELECT 'SUPPLIES', 'dst', l_partkey::VARCHAR, count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey
""")
def relationship_orphans(spark, sf_dir):
    return inspection.orphans(tpch_graph(spark, sf_dir))


@query("""
WITH x AS (SELECT event_type, value, min(value) OVER w AS low, max(value) OVER w AS high FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type))
SELECT event_type, least(floor((value - low) / ((high - low) / 10.0::DOUBLE)), 9)::INTEGER AS bin, count(*) AS n FROM x GROUP BY 1, 2
""")
def value_histogram(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return e.select("event_type", stats.histogram_bin("value", 10, "event_type").alias("bin")).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type)
SELECT event_id, e.event_type, value FROM events e JOIN q ON e.event_type = q.event_type WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)
""")
def value_outliers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    return e.withColumn("far", stats.outlier("value", "event_type")).where("far").drop("far")


def _ranks_sql(rounds: int = 20) -> str:
    """The rounds as one common table after another; the last order of each customer has no next."""
    sql = _NEXT + ", n AS (SELECT count(*) AS n FROM orders), r0 AS (SELECT o_orderkey AS id, 1.0::DOUBLE / n AS s FROM orders, n)"
    for i in range(rounds):
        sql += f""", r{i + 1} AS MATERIALIZED (SELECT r.id, (0.15 / n + 0.85 * (coalesce(x.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM e)) / n))::DOUBLE AS s
          FROM r{i} r CROSS JOIN n LEFT JOIN e ON e.dst = r.id LEFT JOIN r{i} x ON x.id = e.src)"""
    return sql + f" SELECT id, round(s * 1e6, 6) AS score FROM r{rounds}"


@query(_ranks_sql())
def page_rank_of_orders(spark, sf_dir):
    """Of all orders, each linked to its customer's next; scores in millionths."""
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return algorithms.page_rank(nodes, next_orders(spark, sf_dir)).select("id", F.round(F.col("score") * 1e6, 6).alias("score"))
