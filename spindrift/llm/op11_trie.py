"""A trie of conversation prefixes, summed up by pointer jumping.

A node is a distinct sequence of first turns.  Its digest is the XOR of a hash of
each turn and its place, so the prefixes of a conversation are running XORs, cut
into blocks of turns: no conversation, however long, is one task's.  Texts become
digests where they are read and are never shuffled.

Nodes hold the digest of their parent.  What is summed over subtrees rises by
doubling: in round k a node gives the sum over its descendants less than 2^k
below it to the ancestor 2^k above, and then points twice as far, so the rounds
are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, cells

ROWS_PER_CELL = 20_000
#: Turns of one conversation that a window holds.
BLOCK = 1024
KEY = ["depth", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame, scratch: Scratch, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``conv_id``, ``cell``, ``n``, ``i``, ``t1``, ``t2``, ``chars`` of each turn:
    its place from 0 among the ``n`` of its conversation, the digest of role and
    text, and the text's code points.

    Order is by ``turn``, null first, then by digest.  Null role or text is empty;
    rows without ``conv_id`` belong to no conversation and are left out.  ``cell``
    numbers ranges of the order of conversations, and is that of the first turn.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(sha, at, 16), 16, -10).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", part(1).alias("t1"), part(17).alias("t2"), F.length(text).cast("long").alias("chars"))
    rows = scratch.put(rows.withColumn("nth", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "nth"]
    rows = rows.repartitionByRange(cells(rows.count(), rows_per_cell), *order).withColumn("cell", F.spark_partition_id())
    rows = scratch.put(rows, "cells")
    scratch.drop("turns")
    # One row for each conversation and cell; most conversations lie in one cell.
    totals = rows.groupBy("conv_id", "cell").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "conv_id", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"), F.sum("rows").over(whole).alias("n"), F.min("cell").over(whole).alias("first"))
    place = F.row_number().over(Window.partitionBy("conv_id", "cell").orderBy(*order[1:]))
    rows = rows.withColumn("place", place).join(totals, ["conv_id", "cell"])
    out = scratch.put(rows.select("conv_id", F.col("first").alias("cell"), "n", (F.col("ahead") + F.col("place") - 1).alias("i"), "t1", "t2", "chars"), "ordered")
    scratch.drop("cells")
    return out


def with_shared_heads(turns: DataFrame, scratch: Scratch, group: int = 100, most: int = 5) -> DataFrame:
    """Conversations rebuilt with the first turns of another.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % group``, all if it
    has fewer, none if it is absent, and then its own after its first ``h``;
    ``h`` is the checksum of ``c`` modulo ``most + 1``.  A conversation that is left
    without turns has one row whose ``i`` is null.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    turn = F.struct("i", "t1", "t2", "chars")
    conv = turns.groupBy("conv_id", "cell", "n").agg(F.array_sort(F.collect_list(F.when(F.col("i") < most, turn))).alias("head"))
    conv = scratch.put(conv, "heads")
    base = F.col("conv_id") - F.col("conv_id") % group
    # At most 2 * group conversations take their head from one.
    own = conv.select("conv_id", "cell", "n", h.alias("h"), base.alias("base")).join(conv.select(F.col("conv_id").alias("base"), "head"), "base", "left")
    own = own.withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast(conv.schema["head"].dataType)), 1, F.greatest("h", F.lit(1)))).otherwise(F.array().cast(conv.schema["head"].dataType)))
    own = own.withColumn("m", F.size("head")).withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = scratch.put(own.select("conv_id", "cell", "n", "h", "m", "total", "head"), "rebuilt")
    first = own.select("conv_id", "cell", F.col("total").alias("n"), F.explode_outer("head").alias("x"), "m").where("x is not null or n = 0")
    first = first.select("conv_id", "cell", "n", "x.i", "x.t1", "x.t2", "x.chars")
    blocks = own.where("n > h").select("conv_id", "h", "m", "total", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(BLOCK))).alias("block"))
    rest = turns.where(F.col("i") >= h).withColumn("block", F.col("i") - F.col("i") % BLOCK).drop("n").join(blocks, ["conv_id", "block"])
    rest = rest.select("conv_id", "cell", F.col("total").alias("n"), (F.col("i") - F.col("h") + F.col("m")).alias("i"), "t1", "t2", "chars")
    return scratch.put(first.unionByName(rest), "edited")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``depth``, the digest ``k1``, ``k2`` of the turns up to each,
    and ``p1``, ``p2``, that of those before it."""
    g = [F.xxhash64("i", "t1", "t2"), F.xxhash64("t2", "i", "t1")]
    rows = turns.where("i is not null").withColumn("g1", g[0]).withColumn("g2", g[1]).withColumn("block", F.col("i") - F.col("i") % BLOCK)
    # Only conversations of more than a block have anything to carry.
    sums = rows.where(F.col("n") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "block", *(F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(c) for b, c in (("b1", "c1"), ("b2", "c2"))))
    up_to = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k1", F.bit_xor("g1").over(up_to)).withColumn("k2", F.bit_xor("g2").over(up_to)).join(carried, ["conv_id", "block"], "left")
    for k, c in (("k1", "c1"), ("k2", "c2")):
        rows = rows.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0))))
    return rows.select(
        "conv_id", "cell", "n", (F.col("i") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"), "chars")


def _hashed(ends: DataFrame) -> DataFrame:
    """``KEY`` and ``ends_sha256`` of nodes at which conversations end.

    Ids are joined to strings by cell, a bounded number in each; the strings of a
    node then pass through one hash in order, none held longer than it takes.
    """
    parts = ends.groupBy(*KEY, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple] = []
        rows = lambda: pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:3]), pa.array([x[3] for x in out], pa.string())], [*KEY, "ends_sha256"])
        for batch in batches:
            for *at, ids in zip(*(batch.column(name).to_pylist() for name in (*KEY, "ids"))):
                if at == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
            if len(out) >= 4096:
                yield rows()
                out.clear()
        if key is not None:
            out.append((*key, state.hexdigest()))
        if out:
            yield rows()

    dealt = parts.repartition(*KEY).sortWithinPartitions(*KEY, "cell")
    return dealt.select(*KEY, "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """``KEY`` and ``values`` summed over the subtree of each node, itself included.

    ``nodes`` has ``KEY``, the parent's ``p1``, ``p2``, and ``values``.  Node and
    ancestor are ``depth`` apart by the hop alone, so a pointer is a digest.
    """
    sums = [F.sum(v).alias(v) for v in values]
    gains = [nodes.select(*KEY, *values)]
    hop = 1
    active = scratch.put(nodes.where("depth >= 1").select(*KEY, "p1", "p2", *values), "active1")
    while not active.isEmpty():
        up = [(F.col("depth") - hop).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
        gain = scratch.put(active.select(*up, *values).groupBy(*KEY).agg(*sums), f"gain{hop}")
        gains.append(gain)
        # Those that still point at a node with an ancestor point at its ancestor now.
        above = active.select(*KEY, F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        far = active.where(F.col("depth") >= 2 * hop).select(F.col("depth").alias("own"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), *values, *up).join(above, KEY)
        far = far.select(F.col("own").alias("depth"), F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), *values)
        more = gain.select(*KEY, *(F.col(v).alias(f"more_{v}") for v in values))
        far = far.join(more, KEY, "left").select(*KEY, "p1", "p2", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        active = scratch.put(far, f"active{2 * hop}")
        scratch.drop(f"active{hop}")
        hop *= 2
    return reduce(DataFrame.unionByName, gains).groupBy(*KEY).agg(*sums)


def prefix_trie(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of a trie over ``turns`` as :func:`ordered` makes them.

    Returns ``KEY`` (``depth`` and digest) and ``conv_id``, the smallest member;
    ``parent_conv_id``, that of the parent (null at the root); ``n_convs``, members;
    ``n_children``; ``n_leaves``, nodes without children in the subtree;
    ``saved_tokens``, over the subtree, code points of a node's last text for each
    member but one; ``ends_sha256``, of the ids of members that end at the node,
    ascending, joined by commas.  Without conversations there is no node.
    """
    rows = scratch.put(prefixes(turns), "prefixes")
    rootless = turns.where("i is null").select("conv_id", "cell", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    nodes = rows.groupBy(*KEY, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    members = rows.where("depth = 1").select("conv_id").union(rootless.select("conv_id"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in KEY), *(F.lit(None).cast("long").alias(p) for p in ("p1", "p2")), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = scratch.put(nodes.unionByName(root), "nodes")
    children = scratch.put(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")), "children")
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = scratch.put(nodes, "valued")
    scratch.drop("nodes", "children")
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], scratch)
    ends = _hashed(rows.where("depth = n").select(*KEY, "cell", "conv_id").unionByName(rootless.select(*KEY, "cell", "conv_id")))
    # A node with very many children is one row here, and the adaptive skew join splits those.
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(parents, ["depth", "p1", "p2"], "left")
    out = out.join(sums, KEY).join(ends, KEY, "left")
    return out.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shared_heads: bool = False, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """The prefix trie of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    As :func:`prefix_trie`; with ``shared_heads`` conversations are rebuilt first.
    Null role or text is empty, null turns come first, equal turns are ordered by
    the digest of role and text; a repeated row is a turn of its own.  Rows without
    ``conv_id`` are left out.  Other columns are ignored; no rows in, none out.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = ordered(conversations.select("conv_id", "turn", "role", "text"), scratch, rows_per_cell)
    return prefix_trie(with_shared_heads(turns, scratch) if shared_heads else turns, scratch)
