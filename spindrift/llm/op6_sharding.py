"""Contiguous balanced shards from global byte-size prefix sums.

Rows with equal texts are one group and stay together.  Groups are laid out in
order of the text's MD5; a group goes to the shard in which its middle byte
lies, so shards differ from the mean by at most half a group at either end.
The global prefix sum is built from per-partition totals: totals by MD5 range,
prefix sums over the ranges, and a window inside each range.  Group sizes are
summed map-side first, so very many copies of a text are one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import cells, running_offsets

ROWS_PER_CELL = 20_000


def shard(docs: DataFrame, n_shards: int, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` for each row.

    ``size`` is the text's UTF-8 bytes plus 1.  Null text counts as empty and
    groups with empty texts.  Ids may be null or repeat: every row gets a slot
    of its own.  Fewer groups than shards leave shards empty; no rows, no
    output.  Other columns are ignored.
    """
    n = cells(docs.count(), rows_per_cell)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"),
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn(
        "cell", (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * n / F.lit(16**7)).cast("int")
    )
    totals = groups.groupBy("cell").agg(F.sum("bytes").alias("cell_bytes"))
    offsets = running_offsets(totals, [], "cell", "cell_bytes", "ahead").select("cell", "ahead")
    everything = totals.agg(F.sum("cell_bytes").alias("all_bytes"))
    inside = Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        groups.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "cell")  # at most 65536 rows of two numbers
        .crossJoin(F.broadcast(everything))  # one row
        .select("key", F.least(
            F.floor((F.col("ahead") + F.col("inside") + F.col("bytes") / 2) * n_shards / F.col("all_bytes")), F.lit(n_shards - 1),
        ).cast("int").alias("shard"))
    )
    # Slots: rows of a shard counted by cells of the id, so copies spread out.
    out = rows.join(placed, "key").withColumn("at", F.pmod(F.xxhash64("doc_id", "key"), F.lit(n)).cast("int"))
    counts = out.groupBy("shard", "at").agg(F.count("*").alias("rows"))
    first = running_offsets(counts, ["shard"], "at", "rows", "first").select("shard", "at", "first")
    order = Window.partitionBy("shard", "at").orderBy("doc_id", "key")
    return out.withColumn("nth", F.row_number().over(order)).join(F.broadcast(first), ["shard", "at"]).select(  # at most n_shards * 65536 rows
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot")
    )
