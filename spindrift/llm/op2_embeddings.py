"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order.
Inverted lists by label and pivot bring together vectors that share pivots;
pairs that share at least ``min_shared`` of them are verified by cosine in
double precision.

Very many near copies would make quadratically many pairs, so vectors with the
same first pivots and within half the linking angle of the cell's first vector
form a ball: all of it is linked, without comparing.  Lists hold one entry for
each ball; two balls are linked whole, not at all, or, where the triangle
inequality can't tell, member by member.  Long lists are cut in blocks and each
pair of blocks is a task of its own, so no list is gathered in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.llm.components import connected_components

THRESHOLD = 0.93
#: Pivots described for each vector, and how many a pair must share.
PREFIX, MIN_SHARED = 10, 2
#: Pivots: about the root of the number of vectors, first in order of an MD5 of
#: the id (the bounded sample that the index is fitted on).
MIN_PIVOTS, MAX_PIVOTS = 64, 1024
#: First pivots that form a ball's cell.
CELL = 3
BLOCK = 512
#: Slack of angles and cosines against rounding.
EPS = 1e-7


def _units(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the valid rows, and which rows are valid."""
    ok = np.zeros(len(column), bool)
    rows = []
    for i, v in enumerate(column):
        if v is not None and len(v) == dim:
            a = np.asarray(v, dtype=np.float64)  # a null component becomes NaN
            n = np.sqrt(a @ a)
            if np.isfinite(n) and n > 0:
                ok[i] = True
                rows.append(a / n)
    return (np.stack(rows) if rows else np.zeros((0, dim))), ok


def _described(vectors: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """Valid vectors as units with their nearest pivots, in order."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors
    take = min(PREFIX, len(pivots))

    def run(batches):
        for batch in batches:
            units, ok = _units(batch["embedding"], dim)
            # Ties go to the pivot that comes first.
            prefix = np.argsort(-(units @ shared.value.T), axis=1, kind="stable")[:, :take]
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].to_numpy()[ok], "label": batch["label"].to_numpy()[ok], "unit": list(units), "prefix": list(prefix.astype(np.int32)),
                "cell": [",".join(map(str, p[:CELL])) for p in prefix],
            })

    return vectors.mapInPandas(run, "vec_id long, label string, unit array<double>, prefix array<int>, cell string")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what ``a[i] - b[i]`` connect, at most one for each end."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


_FOUND = "kind string, a long, b long, n long"


def _compare(threshold: float, min_shared: int):
    """What one pair of blocks of a list finds: ``add`` rows (ball ``a`` links
    with ``n`` more vectors), ``edge`` rows and ``unsure`` rows."""
    angle = math.acos(threshold)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key[1], key[2], key[3]
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        pa, pb = np.stack(left["prefix"]), np.stack(right["prefix"])
        ua, ub = np.stack(left["unit"]), np.stack(right["unit"])
        top = int(max(pa.max(), pb.max())) + 1
        hot_a, hot_b = np.zeros((len(pa), top), np.float32), np.zeros((len(pb), top), np.float32)
        np.put_along_axis(hot_a, pa, 1, axis=1)
        np.put_along_axis(hot_b, pb, 1, axis=1)
        ida, idb = left["leader"].to_numpy(), right["leader"].to_numpy()
        ask = hot_a @ hot_b.T >= min_shared
        # A pair is judged in the list of the least pivot that it shares.
        ask &= hot_a[:, :pivot] @ hot_b[:, :pivot].T == 0
        if i == j:
            ask &= ida[:, None] < idb[None, :]
        cosine = ua @ ub.T
        x, y = np.nonzero(ask & (cosine >= math.cos(min(math.pi, 2 * angle)) - EPS))
        c = np.einsum("ij,ij->i", ua[x], ub[y])
        theta = np.arccos(np.clip(c, -1, 1))
        ra, rb = left["radius"].to_numpy()[x], right["radius"].to_numpy()[y]
        na, nb = left["n"].to_numpy()[x], right["n"].to_numpy()[y]
        single = (na == 1) & (nb == 1)
        whole = np.where(single, c >= threshold, theta + ra + rb <= angle - EPS)
        unsure = ~single & ~whole & (theta - ra - rb <= angle + EPS)
        a, b = ida[x], idb[y]
        adds = pd.DataFrame({"a": np.concatenate([a[whole], b[whole]]), "n": np.concatenate([nb[whole], na[whole]])}).groupby("a", as_index=False)["n"].sum()
        out = [("add", p, None, q) for p, q in adds.itertuples(index=False)]
        out += [("edge", p, q, None) for p, q in _forest(a[whole], b[whole])]
        out += [("unsure", p, q, None) for p, q in zip(a[unsure].tolist(), b[unsure].tolist())]
        return pd.DataFrame(out, columns=["kind", "a", "b", "n"]).astype({"kind": object, "a": "Int64", "b": "Int64", "n": "Int64"})

    return run


def _dots(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, min_shared: int = MIN_SHARED, block: int = BLOCK, n_pivots: int | None = None
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each input row.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``threshold`` (over 0).  A vector that is null, zero, of another length
    than the first valid one by id, or with null or non-finite components links
    with nothing, and is kept.  Ids are taken to be unique; repeated ids are
    given the same links.  An empty table has an empty result.  Other columns
    are ignored.  Links that are found are exact; those between vectors that
    share fewer than ``min_shared`` pivots (or all, if those are fewer) are missed.
    """
    spark = embeddings.sparkSession
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    # As _units has it; a null component makes the square null.
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    able = base.where("label is not null and vec_id is not null").where((square > 0) & (square < float("inf"))).dropDuplicates(["vec_id"])
    stats = able.agg(F.count("*").alias("n"), F.min(F.struct("vec_id", F.size("embedding").alias("dim")))["dim"].alias("dim")).first()
    nothing = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not stats["n"]:
        return nothing
    want = n_pivots or max(MIN_PIVOTS, min(MAX_PIVOTS, math.isqrt(stats["n"])))
    sample = able.where(F.size("embedding") == stats["dim"]).orderBy(F.md5(F.col("vec_id").cast("string"))).limit(2 * want).select("vec_id", "embedding").toPandas()
    pivots, _ = _units(sample["embedding"], stats["dim"])
    # Copies among the pivots would spend a prefix on one place.
    apart: list[np.ndarray] = []
    for p in pivots:
        if len(apart) < want and all(p @ q < threshold for q in apart):
            apart.append(p)
    if not apart:
        return nothing
    vectors = written(_described(able, stats["dim"], np.stack(apart)), "vectors")

    # Balls: the least id of a cell leads those near enough to it.
    angle = math.acos(threshold)
    first = vectors.groupBy("label", "cell").agg(F.min("vec_id").alias("leader"))
    first = first.join(vectors.select(F.col("vec_id").alias("leader"), F.col("unit").alias("leader_unit")), "leader")
    members = vectors.join(first, ["label", "cell"])
    away = F.when(F.col("vec_id") == F.col("leader"), F.lit(0.0)).otherwise(F.acos(F.least(F.greatest(_dots("unit", "leader_unit"), F.lit(-1.0)), F.lit(1.0))))
    members = members.withColumn("away", away).withColumn("inside", F.col("away") <= angle / 2 - EPS)
    members = written(members.select(
        "vec_id", "label", "unit", F.when(F.col("inside"), F.col("leader")).otherwise(F.col("vec_id")).alias("leader"),
        F.when(F.col("inside"), F.col("away")).otherwise(F.lit(0.0)).alias("away"),
    ), "members")
    balls = members.groupBy("leader").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    entries = balls.join(vectors.withColumnRenamed("vec_id", "leader"), "leader").select(
        "leader", "label", "n", "radius", "unit", "prefix", F.explode("prefix").alias("pivot"))

    # Lists, cut in blocks; every pair of blocks of a list is compared.
    sizes = entries.groupBy("label", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = entries.join(sizes, ["label", "pivot"]).withColumn("block", F.pmod(F.xxhash64("leader"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "leader", "n", "radius", "unit", "prefix")
    grouped = dealt.groupBy("label", "pivot", "i", "j")
    # With few pivots no pair can share more.
    compare = _compare(threshold, min(min_shared, len(apart)))

    def guarded(key, rows):
        if len(rows) < 2 or key[2] not in set(rows["block"]) or key[3] not in set(rows["block"]):
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []}).astype({"kind": object, "a": "Int64", "b": "Int64", "n": "Int64"})
        return compare(key, rows)

    found = written(grouped.applyInPandas(guarded, _FOUND), "found")

    # Ball pairs in doubt: first each member against the other ball's leader ...
    pairs = found.where("kind = 'unsure'").select("a", "b")
    both = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("ball", "other")
    lead = members.where("vec_id = leader").select(F.col("leader").alias("other"), F.col("unit").alias("other_unit"))
    lead = lead.join(balls.select(F.col("leader").alias("other"), F.col("n").alias("other_n"), F.col("radius").alias("other_radius")), "other")
    tested = both.join(members.select(F.col("leader").alias("ball"), "vec_id", "unit"), "ball").join(lead, "other")
    tested = tested.withColumn("theta", F.acos(F.least(F.greatest(_dots("unit", "other_unit"), F.lit(-1.0)), F.lit(1.0))))
    tested = written(tested.select("ball", "other", "vec_id", "other_n", (F.col("theta") + F.col("other_radius") <= angle - EPS).alias("whole"),
                                   (F.col("theta") - F.col("other_radius") <= angle + EPS).alias("maybe"), "unit").where("maybe"), "tested")
    # ... then member against member, with what is still in doubt.
    doubt = tested.where("not whole").select("ball", "other", "vec_id", "unit")
    match = doubt.join(members.select(F.col("leader").alias("other"), F.col("vec_id").alias("with"), F.col("unit").alias("with_unit")), "other")
    match = written(match.where(_dots("unit", "with_unit") >= threshold).select("ball", "other", "vec_id", "with"), "matches")

    adds = found.where("kind = 'add'").groupBy(F.col("a").alias("leader")).agg(F.sum("n").alias("whole_balls"))
    some = tested.where("whole").select("vec_id", F.col("other_n").alias("k")).union(match.select("vec_id", F.lit(1).cast("long")))
    some = some.groupBy("vec_id").agg(F.sum("k").alias("by_member"))
    edges = found.where("kind = 'edge'").select("a", "b").union(tested.where("whole").select("ball", "other")).union(match.select("ball", "other")).distinct()
    parts = connected_components(edges, "a", "b").withColumnRenamed("id", "leader")
    linked = members.select("vec_id", "leader").join(balls.select("leader", "n"), "leader").join(adds, "leader", "left").join(parts, "leader", "left").join(some, "vec_id", "left").select(
        "vec_id", (F.col("n") - 1 + F.coalesce("whole_balls", F.lit(0)) + F.coalesce("by_member", F.lit(0))).alias("links"), F.coalesce("component", "leader").alias("component"))
    return base.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
