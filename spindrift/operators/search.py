"""Full-text, vector and hybrid search, and retrieval metrics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import vector

#: Words that no query is about (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "with", "this",
    "but", "they", "we", "you", "your", "my", "their", "been", "do", "does", "did",
)
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, two bytes or more, no stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: F.octet_length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def postings(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """``id``, ``term``, ``tf``, ``length``: one row for each word of a document.
    Written partitioned or bucketed by ``term`` it is the inverted index."""
    words = docs.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("w"))
    return words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, id_: str = "id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """``id``, ``score`` of documents that hold a word of the query.

    With ``prefixes``, longer words that start with a query word count at 0.8 of
    their own rarity.  Only the query's words are ever grouped; statistics are
    taken in the same pass over the texts.
    """
    wanted = sorted({w for w in re.findall(r"[^\W_]+", query.lower()) if len(w.encode()) >= 2 and w not in STOP_WORDS})
    sized = docs.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    keep = (lambda t: F.exists(F.array(*map(F.lit, wanted)), t.startswith)) if prefixes else (lambda t: t.isin(*wanted))
    if not wanted:
        return sized.select("id", F.lit(0.0).alias("score")).where("false")
    hits = sized.select("id", "length", F.explode(F.filter("w", keep)).alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.when(F.col("term").isin(*wanted), 1.0).otherwise(0.8)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def phrase(docs: DataFrame, words: str, text: str = "text") -> DataFrame:
    """Documents that hold the phrase, letter case ignored."""
    return docs.where(F.contains(F.lower(text), F.lit(words.lower())))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def vector_top(vectors: DataFrame, query: list[float], k: int, least: float | None = None, id_: str = "id", vector_column: str = "embedding", similarity: str = "cosine") -> DataFrame:
    """``id``, ``score`` of the ``k`` most similar vectors, by full scan.
    Vectors of another length are skipped."""
    q = F.array(*map(F.lit, map(float, query)))
    measure = {"cosine": vector.similarity_cosine, "euclidean": vector.similarity_euclidean, "dot": vector.dot}[similarity]
    found = vectors.where(F.size(vector_column) == len(query)).select(F.col(id_).alias("id"), measure(F.col(vector_column), q).alias("score"))
    return top(found if least is None else found.where(F.col("score") >= least), k)


def similar_to(vectors: DataFrame, node, k: int, id_: str = "id", vector_column: str = "embedding") -> DataFrame:
    """As :func:`vector_top`, for a vector of the table, itself left out."""
    row = vectors.where(F.col(id_) == node).select(vector_column).first()
    if row is None:
        return vectors.select(F.col(id_).alias("id"), F.lit(0.0).alias("score")).where("false")
    return vector_top(vectors.where(F.col(id_) != node), row[0], k, id_=id_, vector_column=vector_column)


def fuse(*rankings: DataFrame, weights: list[float] | None = None, k: int = 60, least: float = 0.01) -> DataFrame:
    """Reciprocal rank fusion of ``id``, ``score`` tables of bounded top lists."""
    parts = None
    for r, w in zip(rankings, weights or [1.0] * len(rankings)):
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        part = r.select("id", (F.lit(w) / (k + place)).alias("s"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy("id").agg(F.sum("s").alias("score")).where(F.col("score") >= least)


def adaptive_weights(query: str) -> tuple[float, float]:
    """Vector and text weights: short queries lean on words, long ones on meaning."""
    n = len(query.split())
    return (0.5, 1.5) if n <= 2 else (1.5, 0.5) if n >= 6 else (1.0, 1.0)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, k: int, id_: str = "id") -> DataFrame:
    """Text and vector hits, ``2 * k`` of each, fused; text alone without a vector."""
    words = top(bm25(docs, query, id_), 2 * k)
    if query_vector is None:
        return top(words, k)
    near = vector_top(vectors, query_vector, 2 * k, id_=id_)
    return top(fuse(near, words, weights=list(adaptive_weights(query))), k)


def diversified(ranked: DataFrame, vectors: DataFrame, k: int, trade: float = 0.7, id_: str = "id", vector_column: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over a bounded top list (``id``, ``score``).

    Greedy, so it runs in one group of the list's rows; give it ``2 * k`` or so.
    """
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(rows["v"])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, chosen, s = np.zeros(len(rows)), [], rows["score"].to_numpy()
        for _ in range(min(k, len(rows))):
            gain = trade * s - (1 - trade) * near
            gain[chosen] = -np.inf
            i = int(gain.argmax())
            chosen.append(i)
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"id": rows["id"].iloc[chosen], "place": np.arange(1, len(chosen) + 1)})

    both = ranked.join(vectors.select(F.col(id_).alias("id"), F.col(vector_column).cast("array<double>").alias("v")), "id")
    kind = both.schema["id"].dataType.simpleString()
    return both.groupBy(F.lit(0).alias("g")).applyInPandas(lambda _, rows: pick(rows[["id", "score", "v"]]), f"id {kind}, place long")


def clusters(vectors: DataFrame, k: int | None = None, id_: str = "id", vector_column: str = "embedding", seed: int = 42):
    """A k-means model of the vectors; ``k`` is root of half their number, 10 to 1000."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    k = k or max(1, min(n, max(10, min(1000, int((n / 2) ** 0.5)))))
    data = vectors.select(F.col(id_).alias("id"), array_to_vector(F.col(vector_column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20, tol=1e-4).fit(data)
    return model, model.transform(data).select("id", F.col("prediction").alias("cluster"))


def clustered_top(vectors: DataFrame, model, assigned: DataFrame, query: list[float], k: int, probes: int = 3, id_: str = "id") -> DataFrame:
    """The ``k`` nearest within the ``probes`` clusters nearest to the query."""
    import numpy as np

    centres = np.stack(model.clusterCenters())
    nearest = np.argsort(((centres - np.array(query)) ** 2).sum(axis=1), kind="stable")[:probes].tolist()
    ids = assigned.where(F.col("cluster").isin(*nearest)).select(F.col("id").alias(id_))
    return vector_top(vectors.join(ids, id_, "left_semi"), query, k, id_=id_)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query``, ``precision``, ``recall``, ``reciprocal_rank``, ``ndcg``,
    ``average_precision``, ``hit`` at ``k``; ``ranked`` has ``query``, ``id``, ``place``
    and ``relevant`` has ``query``, ``id``, ``grade``."""
    hits = ranked.where(F.col("place") <= k).join(relevant, ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    good = F.col("grade") > 0
    so_far = F.sum(good.cast("int")).over(Window.partitionBy("query").orderBy("place"))
    found = hits.withColumn("found", so_far).groupBy("query").agg(
        F.sum(good.cast("int")).alias("good"), F.min(F.when(good, F.col("place"))).alias("first"),
        F.sum((F.pow(2, "grade") - 1) / F.log2(F.col("place") + 1)).alias("dcg"), F.sum(F.when(good, F.col("found") / F.col("place")).otherwise(0.0)).alias("ap"))
    ideal = relevant.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))).groupBy("query").agg(
        F.sum((F.col("grade") > 0).cast("int")).alias("all"), F.sum(F.when(F.col("place") <= k, (F.pow(2, "grade") - 1) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(found, "query", "left").select(
        "query", zero(F.col("good") / k).alias("precision"), zero(F.try_divide("good", "all")).alias("recall"), zero(F.try_divide(F.lit(1), F.col("first"))).alias("reciprocal_rank"),
        zero(F.try_divide("dcg", "idcg")).alias("ndcg"), zero(F.try_divide("ap", F.least("all", F.lit(k)))).alias("average_precision"), F.coalesce(F.col("good") > 0, F.lit(False)).alias("hit"))


def highlight(text: Column, words: str, before: str = "<em>", after: str = "</em>") -> Column:
    return F.regexp_replace(text, f"(?i)({'|'.join(map(re.escape, words.split()))})", f"{before}$1{after}")


def fuzzy(nodes: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Nodes whose property is within ``most`` edits of a value, nearest first."""
    d = F.levenshtein(F.col(key), F.lit(value))
    return nodes.withColumn("distance", d).where(F.col("distance") <= most).orderBy("distance", key)


def suggest(nodes: DataFrame, key: str, prefix: str, k: int = 10) -> DataFrame:
    """Distinct property values that start with a prefix, in order."""
    return nodes.where(F.col(key).startswith(prefix)).select(key).distinct().orderBy(key).limit(k)


def did_you_mean(nodes: DataFrame, key: str, wanted: str, distance: int = 2) -> DataFrame:
    """``suggestion``, ``distance``: the values of a property within an edit distance."""
    apart = F.levenshtein(F.col(key), F.lit(wanted), distance)  # -1 beyond it
    return nodes.select(F.col(key).alias("suggestion"), apart.alias("distance")).where("distance >= 0").distinct()


def multi_search(graph, labels: list[str], condition) -> DataFrame:
    """``id``, ``label`` of nodes of several labels that fit; ``condition`` makes
    a column of a label's table."""
    found = [t.where(condition(t)).select(F.col("id").cast("string").alias("id"), F.lit(n).alias("label")) for n, t in ((n, graph.nodes(n)) for n in labels)]
    return reduce(DataFrame.unionAll, found)
