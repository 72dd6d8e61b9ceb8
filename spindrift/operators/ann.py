"""Approximate nearest neighbours over proximity graphs in tables.

Vectors are dealt by a hash of their id into shards of a bounded size.  Each
shard is a layered graph: a vector is in the layers up to a level that its id's
hash draws, with odds that fall by a constant factor; in each it is linked with
vectors near to it that aren't nearer to one another.  A search goes down the layers
greedily and then widens in the lowest; shards are searched apart and their
best merged, so the index is as large as there are executors for it.

An index is a folder of tables that only grow: ``graph``, a row for each vector,
by segment, and ``removed``.  Inserting writes a segment, removing writes ids that
searches leave out of results but still pass through; :meth:`VectorIndex.compact`
writes one segment of what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = "segment int, shard int, node int, id long, level int, vector array<float>, links array<array<int>>"
HIT = "query long, id long, segment int, score double"
#: Queries that a shard is searched for at once.
QUERIES_AT_ONCE = 2048


@dataclass(frozen=True)
class Settings:
    """Links of a node in a layer (twice as many in the lowest), width of the
    candidates that links are chosen from, and most vectors of a shard."""

    links: int = 16
    candidates: int = 64
    rows_per_shard: int = 8192


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _levels(ids: np.ndarray, links: int) -> np.ndarray:
    """A level for each id: each further one has odds of 1 in ``links``."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    share = (h >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(1 - share) / np.log(links)).astype(np.int64)


def _nearest(vectors: np.ndarray, among: np.ndarray, k: int, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` of ``among`` most similar to each vector, itself left out, nearest first,
    and how similar."""
    n = len(vectors)
    near, scores = np.empty((n, k), np.int64), np.empty((n, k), np.float32)
    others = vectors[among]
    column = np.full(n, -1, np.int64)
    column[among] = np.arange(len(among))
    for at in range(0, n, rows):
        s = vectors[at : at + rows] @ others.T
        own = column[at : at + rows]
        s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(among) else np.argsort(-s, axis=1)[:, :k]
        found = np.take_along_axis(s, best, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        near[at : at + rows], scores[at : at + rows] = among[np.take_along_axis(best, order, 1)], np.take_along_axis(found, order, 1)
    near[~np.isfinite(scores)] = -1
    return near, scores


def _spread(vectors: np.ndarray, near: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates, nearest first, those not nearer to one that was
    chosen before than to the vector itself; ``-1`` where there are fewer.  Room that
    is left goes to the nearest of the others."""
    n, k = near.shape
    chosen = np.full((n, most), -1, np.int64)
    filled = np.zeros(n, np.int64)
    taken = np.zeros((n, k), bool)
    rows = np.arange(n)
    for j in range(k):
        here = near[:, j]
        open_ = (filled < most) & (here >= 0)
        between = np.einsum("nd,nmd->nm", vectors[np.maximum(here, 0)], vectors[np.maximum(chosen, 0)])
        between[chosen < 0] = -np.inf
        good = open_ & (between.max(axis=1) < scores[:, j])
        chosen[rows[good], filled[good]] = here[good]
        filled += good
        taken[:, j] = good
    for j in range(k):
        good = (filled < most) & ~taken[:, j] & (near[:, j] >= 0)
        chosen[rows[good], filled[good]] = near[good, j]
        filled += good
    return chosen


def _layer(vectors: np.ndarray, level: np.ndarray, most: int, candidates: int) -> np.ndarray:
    """Links of each vector of a layer, ``-1`` where there are fewer than ``most``.

    Candidates are the nearest vectors of the layer, and the nearest of those that
    are in each layer above: among very many near copies the former are all alike,
    and the latter lead out of them.
    """
    n = len(vectors)
    if n < 2:
        return np.full((n, most), -1, np.int64)
    near, scores = _nearest(vectors, np.arange(n), min(n - 1, candidates))
    for upper in range(int(level.min()) + 1, int(level.max()) + 1):
        among = np.flatnonzero(level >= upper)
        more, how = _nearest(vectors, among, min(len(among), most // 2))
        near, scores = np.concatenate([near, more], axis=1), np.concatenate([scores, how], axis=1)
    order = np.lexsort((near, -scores), axis=1)
    near, scores = np.take_along_axis(near, order, 1), np.take_along_axis(scores, order, 1)
    by_node = np.argsort(near, axis=1, kind="stable")
    sorted_ = np.take_along_axis(near, by_node, 1)
    again = np.zeros(near.shape, bool)
    np.put_along_axis(again, by_node[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
    near[again] = -1
    out = _spread(vectors, near, scores, most // 2)
    # Links go both ways; beyond its own choice a node keeps the nearest of those that chose it.
    a, b = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs, first = np.unique(np.concatenate([a * n + b, b * n + a]), return_index=True)
    own = first < len(a)
    a, b = pairs // n, pairs % n
    order = np.lexsort((b, -np.einsum("nd,nd->n", vectors[a], vectors[b]), ~own, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    links = np.full((n, most), -1, np.int64)
    keep = place < most
    links[a[keep], place[keep]] = b[keep]
    return links


def _graph(rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """A shard's vectors with their links in every layer."""
    rows = rows.sort_values("id", ignore_index=True)
    vectors = _unit(np.stack(rows["vector"].to_numpy()).astype(np.float32))
    level = _levels(rows["id"].to_numpy(), settings.links)
    links: list[list[list[int]]] = [[] for _ in range(len(rows))]
    for layer in range(int(level.max()) + 1):
        inside = np.flatnonzero(level >= layer)
        found = _layer(vectors[inside], level[inside], settings.links * (2 if layer == 0 else 1), settings.candidates)
        for node, near in zip(inside.tolist(), found):
            links[node].append(inside[near[near >= 0]].tolist())
    return pd.DataFrame({
        "segment": rows["segment"].astype("int32"), "shard": rows["shard"].astype("int32"), "node": np.arange(len(rows), dtype="int32"), "id": rows["id"], "level": level.astype("int32"),
        "vector": list(vectors), "links": links,
    })


class _Shard:
    """A shard's graph in arrays, searched for many queries at once."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("node", ignore_index=True)
        self.ids, self.segment = rows["id"].to_numpy(), rows["segment"].to_numpy()
        self.vectors = np.stack(rows["vector"].to_numpy()).astype(np.float32)
        level = rows["level"].to_numpy()
        self.layers = []
        for layer in range(int(level.max()) + 1):
            width = max(1, max((len(x[layer]) for x, top in zip(rows["links"], level) if top >= layer), default=1))
            links = np.full((len(rows), width), -1, np.int64)
            for node, (x, top) in enumerate(zip(rows["links"], level)):
                if top >= layer:
                    links[node, : len(x[layer])] = x[layer]
            self.layers.append(links)
        self.entry = int(np.argmax(level))

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` nodes for each query, best first, and their scores; -1 where
        fewer were reached."""
        at = np.full(len(queries), self.entry)
        for links in reversed(self.layers[1:]):
            at = self._descend(queries, at, links)
        return self._widen(queries, at, self.layers[0], width)

    def _scores(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        s = np.einsum("qd,qmd->qm", queries, self.vectors[np.maximum(nodes, 0)])
        s[nodes < 0] = -np.inf
        return s

    def _descend(self, queries: np.ndarray, at: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Greedy: to the best neighbour while one is better."""
        best = self._scores(queries, at[:, None])[:, 0]
        moving = np.arange(len(queries))
        while len(moving):
            near = links[at[moving]]
            s = self._scores(queries[moving], near)
            j = s.argmax(axis=1)
            top = s[np.arange(len(moving)), j]
            better = top > best[moving]
            moving, near, j, top = moving[better], near[better], j[better], top[better]
            at[moving], best[moving] = near[np.arange(len(moving)), j], top
        return at

    def _widen(self, queries: np.ndarray, at: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best first: the best open candidate of each query is extended until all of
        its ``width`` best are."""
        n, q = len(self.ids), len(queries)
        width = min(width, n)
        nodes, scores = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32)
        opened = np.zeros((q, width), bool)
        seen = np.zeros((q, n), bool)
        nodes[:, 0], scores[:, 0] = at, self._scores(queries, at[:, None])[:, 0]
        seen[np.arange(q), at] = True
        left = np.arange(q)
        while len(left):
            todo = np.where(opened[left] | (nodes[left] < 0), -np.inf, scores[left])
            j = todo.argmax(axis=1)
            more = todo[np.arange(len(left)), j] > -np.inf
            left, j = left[more], j[more]
            if not len(left):
                break
            opened[left, j] = True
            near = links[nodes[left, j]]
            fresh = (near >= 0) & ~seen[left[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, -1)
            rows, cols = np.nonzero(fresh)
            seen[left[rows], near[rows, cols]] = True
            s = self._scores(queries[left], near)
            all_nodes, all_scores = np.concatenate([nodes[left], near], axis=1), np.concatenate([scores[left], s], axis=1)
            all_opened = np.concatenate([opened[left], np.zeros_like(fresh)], axis=1)
            best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
            nodes[left], scores[left], opened[left] = (np.take_along_axis(x, best, 1) for x in (all_nodes, all_scores, all_opened))
        order = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)


class VectorIndex:
    """Approximate cosine search over vectors with long ids, in tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()) -> None:
        self.spark, self.path, self.settings = spark, path, settings

    def _graph(self) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.path}/graph")

    def _removed(self) -> DataFrame:
        """``id``, ``until``: vectors of the id in segments up to ``until`` are removed."""
        return self.spark.read.schema("id long, until int").parquet(f"{self.path}/removed").groupBy("id").agg(F.max("until").alias("until"))

    def _segment(self) -> int:
        last = self._graph().agg(F.max("segment")).first()[0]
        return -1 if last is None else last

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_: str = "id", vector: str = "embedding", settings: Settings = Settings()) -> VectorIndex:
        """An index of ``vectors`` in a new folder.

        Vectors that are null, zero, hold null or non-finite numbers or have no id
        are in no graph, and not found; of an id that repeats the greatest is
        taken.  All vectors must have one length.
        """
        spark = vectors.sparkSession
        spark.createDataFrame([], NODE).write.parquet(f"{path}/graph")
        spark.createDataFrame([], "id long, until int").write.parquet(f"{path}/removed")
        index = cls(spark, path, settings)
        index.insert(vectors, id_, vector)
        return index

    def insert(self, vectors: DataFrame, id_: str = "id", vector: str = "embedding") -> None:
        """Add a segment of ``vectors``; one whose id is there takes its place."""
        v = F.col("vector")
        rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        # Infinite and undefined numbers are the ones that differ from themselves times nothing.
        good = F.coalesce(F.forall(v, lambda x: x * 0 == 0) & F.exists(v, lambda x: x != 0), F.lit(False))
        rows = rows.where("id is not null").where(good).groupBy("id").agg(F.max("vector").alias("vector"))
        segment, n = self._segment() + 1, rows.count()
        shards = max(1, -(-n // max(1, self.settings.rows_per_shard * 3 // 4)))  # hashing fills shards unevenly
        rows = rows.withColumn("segment", F.lit(segment)).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        settings = self.settings
        graph = rows.groupBy("segment", "shard").applyInPandas(lambda part: _graph(part, settings), NODE)
        graph.write.mode("append").parquet(f"{self.path}/graph")
        if segment:  # after it, so that a failure in between takes nothing away
            rows.select("id", F.lit(segment - 1).alias("until")).write.mode("append").parquet(f"{self.path}/removed")

    def remove(self, ids: DataFrame, id_: str = "id") -> None:
        """Leave ids out of results from now on; unknown ones are no error."""
        ids.select(F.col(id_).cast("long").alias("id"), F.lit(self._segment()).alias("until")).where("id is not null").distinct().write.mode("append").parquet(f"{self.path}/removed")

    def vectors(self) -> DataFrame:
        """``id``, ``embedding``: what is in the index, scaled to length 1."""
        rows = self._graph().join(self._removed(), "id", "left").where("until is null or segment > until")
        return rows.select("id", F.col("vector").alias("embedding"))

    def size(self) -> int:
        return self.vectors().count()

    def compact(self, path: str) -> VectorIndex:
        """The same vectors as one segment in a new folder."""
        return VectorIndex.build(self.vectors(), path, settings=self.settings)

    def search(self, queries: DataFrame, k: int = 10, least: float | None = None, width: int = 100, id_: str = "id", vector: str = "embedding") -> DataFrame:
        """``query``, ``id``, ``score``: for each query the ``k`` most similar vectors that
        its search reached, of ``least`` similarity if given.

        ``width`` candidates (``k`` at least) are kept for a query in each shard;
        wider searches find more.  Queries are dealt in blocks, each met once with
        each shard; a query without an id or a usable vector has no rows.
        """
        width, at_once = max(width, k), QUERIES_AT_ONCE
        v = F.col("v")
        asked = queries.select(F.col(id_).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("v")).where("query is not null and v is not null").where(F.coalesce(F.forall(v, lambda x: x * 0 == 0), F.lit(False)))
        graph, blocks = self._graph(), max(1, -(-asked.count() // at_once))
        shards = self._graph().select("segment", "shard").distinct()
        # Shards are numbered from 0 in each segment: a short list, a row for some thousand vectors.
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).crossJoin(shards)
        dealt = graph.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def find(nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"query": [], "id": [], "segment": [], "score": []}).astype({"query": "int64", "id": "int64", "segment": "int32", "score": "float64"})
            if not len(nodes) or not len(wanted):
                return out
            shard = _Shard(nodes)
            wanted = wanted[wanted["v"].map(len) == shard.vectors.shape[1]]
            parts = [out]
            for at in range(0, len(wanted), at_once):
                some = wanted.iloc[at : at + at_once]
                found, scores = shard.search(_unit(np.stack(some["v"].to_numpy()).astype(np.float32)), width)
                rows, cols = np.nonzero(found >= 0)
                hit = found[rows, cols]
                parts.append(pd.DataFrame({"query": some["query"].to_numpy()[rows], "id": shard.ids[hit], "segment": shard.segment[hit], "score": scores[rows, cols].astype("float64")}))
            return pd.concat(parts, ignore_index=True) if len(parts) > 1 else out

        keys = ["segment", "shard", "block"]
        hits = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(find, HIT)
        hits = hits.join(self._removed(), "id", "left").where("until is null or segment > until")
        if least is not None:
            hits = hits.where(F.col("score") >= least)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return hits.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "score")


def ranked_again(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """``query``, ``id``, ``score``: what a search found, by the cosine of the vectors
    themselves in double precision, the ``k`` best."""
    from spindrift.functions.vector import similarity_cosine

    q = queries.select(F.col(id_).alias("query"), F.col(vector).alias("a"))
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("b"))
    scored = found.select("query", "id").join(q, "query").join(v, "id").select("query", "id", similarity_cosine(F.col("a"), F.col("b")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``recall``: the share of ``exact`` (``query``, ``id``) that was found."""
    hit = exact.select("query", "id").distinct().join(found.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left")
    return hit.agg(F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(1.0)).alias("recall"))
