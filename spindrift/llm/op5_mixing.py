"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in shuffled order (an MD5 of seed and id).  The
virtual finish time of a document is the tokens its source has sent up to its
end, divided by the source's target.  All sources' documents are then put in
order of virtual time, whatever their source, and cut where the running total
reaches the budget.  A second pass over a source queues behind the first.

Both running totals are two-level prefix sums: totals by cell (a range of the
order), prefix sums over cells, then a window inside each cell.  No window spans
a source or the corpus, so a source with a third of all rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import WORD, cells, running_offsets

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix"
ROWS_PER_CELL = 4_000
#: Service ends at this virtual time; sources send their target by time 1.
HORIZON = 4.0


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("key")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target``: one row for each source.

    Sources by code point, null last, take ``weights`` in turn.  A target stops
    at ``most`` times its source's size; what is over is shared again by weight.
    Sorted by size per weight, the sources that stop are a prefix, so the level
    at which the rest settle is a running sum, not a loop.  The windows see one
    row for each source.
    """
    one = Window.partitionBy(F.lit(0))
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = named.withColumn("i", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
    # A tie in size per weight goes by place among the sources.
    before = one.orderBy(F.col("source_size") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    named = (
        named.withColumn("budget", F.sum("source_size").over(one) * F.lit(share))
        .withColumn("left", F.col("budget") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("stops", most * F.col("source_size") <= F.col("level") * F.col("weight"))
        .withColumn("rest", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "i", "level"))).over(one)["level"])
    )
    return named.select(
        "source", "source_size",
        F.when(F.col("stops"), (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("rest") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: str = SEED,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """How often each document is taken.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``repeats``, ``taken``, ``tie`` (MD5 of the text); one row for each input row.  Null or empty text has
    size 0 and is never taken.  A null source is a source of its own.  Rows with
    the same id are separate documents, ordered by text among themselves.  No
    rows in, none out.  Other columns are ignored.

    A document is taken while the middle of its virtual service time lies within
    the budget, so the error of a source is at most half a document.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    n = cells(docs.count(), rows_per_cell)
    sized = sized.withColumn("cell", (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * n / F.lit(16**7)).cast("int"))
    targets = source_targets(sized, weights, share, most)

    # Tokens of the source ahead of a document: cells before, then rows before.
    totals = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = running_offsets(totals, ["source"], "cell", "cell_size", "ahead").select("source", "cell", "ahead")
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    per_source = ahead.alias("a").join(targets.alias("t"), F.expr("a.source <=> t.source")).select("a.source", "cell", "ahead", "source_size", "target")
    queued = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("nth", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .alias("d").join(per_source.alias("p"), F.expr("d.source <=> p.source and d.cell = p.cell"))
        .select("d.*", "source_size", "target", (F.col("inside") + F.col("ahead")).alias("start"))
    )
    # Virtual time of the middle of each pass; time 1 is where each source has
    # sent its target, so the budget ends near 1 and cells of time are even.
    passes = F.sequence(F.lit(0), F.lit(most - 1))
    served = queued.select("*", F.explode(passes).alias("pass")).withColumn(
        "time", F.when(F.col("target") > 0, (F.col("start") + F.col("pass") * F.col("source_size") + F.col("size") / 2) / F.col("target")).otherwise(F.lit(2 * HORIZON))
    ).withColumn("slice", F.when(F.col("time") <= HORIZON, F.floor(F.col("time") * n)).otherwise(F.lit(int(HORIZON * n) + 1) + F.crc32("key") % n))
    slices = served.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    slices = running_offsets(slices, [], "slice", "slice_size", "sent").select("slice", "sent")
    total = sized.agg((F.sum("size") * F.lit(share)).alias("budget"))
    order = Window.partitionBy("slice").orderBy("time", "key", "doc_id", "tie", "pass").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        served.withColumn("earlier", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .join(slices, "slice")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("in", (F.col("sent") + F.col("earlier") + F.col("size") / 2 <= F.col("budget")) & (F.col("size") > 0) & (F.col("time") <= HORIZON))
    )
    return taken.groupBy("doc_id", "source", "key", "tie", "size", "source_size", "target", "cell", "nth").agg(
        F.sum(F.col("in").cast("long")).alias("repeats")
    ).select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), "tie")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a row as often as it is taken.

    Takes the options of :func:`mix`.  Columns are unchanged.
    """
    tie = F.md5(F.coalesce("text", F.lit("")))
    often = mix(docs, **how).where("repeats > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie")).agg(F.sum("repeats").cast("int").alias("__repeats"))
    keyed = docs.withColumn("__key", tie).dropDuplicates(["doc_id", "source", "__key"])
    same = (keyed["doc_id"].eqNullSafe(often["__id"])) & (keyed["source"].eqNullSafe(often["__source"])) & (keyed["__key"] == often["__tie"])
    return keyed.join(often, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select(*docs.columns)
