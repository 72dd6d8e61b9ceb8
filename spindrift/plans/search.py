"""Search and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import search
from spindrift.plans import query

QUERY = "license the version idiot"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


#: The values of ``search.STOP_WORDS``, written out so that the SQL stands on its own.
_STOP = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'to', 'was', 'were', 'with', 'this',
'but', 'they', 'we', 'you', 'your', 'my', 'their', 'been', 'do', 'does', 'did'"""
_BM25 = rf"""
WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{Nd}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({_STOP})) AS words FROM documents),
s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w), h AS (SELECT id, len(words) AS length, unnest(words) AS term FROM w),
t AS (SELECT id, length, term, count(*) AS tf FROM h WHERE term IN ('license', 'version', 'idiot') GROUP BY id, length, term), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
b AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM t JOIN d USING (term) CROSS JOIN s GROUP BY id)
"""


@query(_BM25 + "SELECT id, round(score, 6) AS score FROM b")
def bm25(spark, sf_dir):
    return search.bm25(_docs(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'apache license')")
def phrase_search(spark, sf_dir):
    return search.phrase(_docs(spark, sf_dir), "Apache License").select("id")


_VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v ORDER BY id LIMIT 1)"


@query(f"WITH {_VECTORS} SELECT id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q ORDER BY list_cosine_similarity(e, q) DESC, id LIMIT 10")
def vector_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    first = v.orderBy("id").first()["embedding"]
    return search.vector_top(v, first, 10).withColumn("score", F.round("score", 6))


@query(_BM25 + f""", {_VECTORS}, near AS (SELECT id, list_cosine_similarity(e, q) AS score FROM v, q ORDER BY score DESC, id LIMIT 20), words AS (SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20),
r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM near UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM words)
SELECT id, round(sum(s), 8) AS score FROM r GROUP BY id HAVING sum(s) >= 0.01 ORDER BY sum(s) DESC, id LIMIT 10
""")
def hybrid_search(spark, sf_dir):
    """Vectors are taken to be those of the documents of the same number."""
    v = _vectors(spark, sf_dir)
    first = v.orderBy("id").first()["embedding"]
    return search.hybrid(_docs(spark, sf_dir), v, QUERY, first, 10).withColumn("score", F.round("score", 8))


@query("""
WITH r AS (SELECT source AS query, d.doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS place, coalesce(quality, 0) AS grade, quality IS NOT NULL AS judged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
h AS (SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY query ORDER BY place) AS found FROM r WHERE place <= 10),
g AS (SELECT query, sum((grade > 0)::INT) AS good, min(CASE WHEN grade > 0 THEN place END) AS first, sum((power(2, grade) - 1) / log2(place + 1)) AS dcg, sum(CASE WHEN grade > 0 THEN found / place ELSE 0 END) AS ap FROM h GROUP BY query),
i AS (SELECT query, sum((grade > 0)::INT) AS n, sum(CASE WHEN k <= 10 THEN (power(2, grade) - 1) / log2(k + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS k FROM r WHERE judged) GROUP BY query)
SELECT query, round(coalesce(good / 10.0, 0), 6) AS precision, round(coalesce(good / nullif(n, 0), 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg,
  round(coalesce(ap / nullif(least(n, 10), 0), 0), 6) AS average_precision, coalesce(good > 0, false) AS hit FROM i LEFT JOIN g USING (query)
""")
def retrieval_metrics(spark, sf_dir):
    """Documents of a source ranked by length, against their quality labels."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = d.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), place.alias("place"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    relevant = d.select(F.col("source").alias("query"), F.col("doc_id").alias("id")).join(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("grade")), "id")
    out = search.metrics(ranked, relevant, 10)
    return out.select("query", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg", "average_precision")), "hit")


@query("SELECT p_partkey AS id, levenshtein(p_brand, 'Brand#11')::INTEGER AS distance FROM part WHERE levenshtein(p_brand, 'Brand#11') <= 1")
def fuzzy_search(spark, sf_dir):
    return search.fuzzy(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", "Brand#11", 1).select(F.col("p_partkey").alias("id"), "distance")


@query()
def clustered_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    model, assigned = search.clusters(v, k=10)
    return search.clustered_top(v, model, assigned, v.orderBy("id").first()["embedding"], 10, probes=3)


@query()
def diversified_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = search.vector_top(v, v.orderBy("id").first()["embedding"], 20)
    return search.diversified(near, v, 10)
