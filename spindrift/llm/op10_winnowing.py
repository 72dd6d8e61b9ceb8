"""Document fingerprints by winnowing.

Hashes of word k-grams roll over the text; of every window of ``window``
consecutive hashes the least is chosen, the rightmost on ties, and kept with its
position.  Any run of ``window + k - 1`` words that two texts share leaves a
common hash in both fingerprints.

DataFrame functions only: a hash and its position are packed in one number, high
bits the hash and low bits the position counted from the end, so the least
number of a window is the least hash at its rightmost place.  Neighbouring k-grams
and windows share almost all they hold, so both are put together from runs of
half their length, and those from halves again: log2 steps a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import cells

K = 5
WINDOW = 12
#: Low bits that hold a position; a text has fewer words than this allows.
POSITION_BITS = 27
ROWS_PER_CELL = 2_000


def _rolled(df: DataFrame, column: str, size: int, both: Callable[[Column, Column], Column]) -> DataFrame:
    """``column`` with, at each place, what ``size`` elements from there on come to.

    ``both`` joins two runs, the second null where the array ends before it.
    Runs of powers of two are columns, so none is computed twice.
    """
    ahead = lambda x, steps: F.slice(x, F.lit(steps + 1), F.greatest(F.size(x), F.lit(1)))
    run, length, whole, done = column, 1, None, 0
    while True:
        if size & length:
            df = df.withColumn(f"{column}_{done + length}_in_all", F.col(run) if whole is None else F.zip_with(run, ahead(whole, length), both))
            whole, done = f"{column}_{done + length}_in_all", done + length
        if 2 * length > size:
            return df.withColumn(column, F.col(whole))
        df = df.withColumn(f"{column}_{2 * length}", F.zip_with(run, ahead(run, length), both))
        run, length = f"{column}_{2 * length}", 2 * length


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with column ``out``: array of chosen (hash, position), packed.

    A text of fewer than ``k`` words is one k-gram of all its words; one without
    words, or null, has an empty array.
    """
    names, low, one = df.columns, (1 << POSITION_BITS) - 1, F.lit(1)
    grams = f"__{out}_grams"
    hashed = F.transform(
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)
    )
    # A hash of two runs of words; xxhash64 passes over null.
    df = _rolled(df.withColumn(grams, hashed), grams, k, lambda x, y: F.xxhash64(x, y))
    first = F.slice(grams, one, F.greatest(F.size(grams) - k + 1, one))
    packed = F.transform(first, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.lit(low - 1) - i))
    df = _rolled(df.withColumn(grams, packed), grams, window, lambda x, y: F.least(x, y))
    return df.select(*(F.col(c) for c in names if c != out), F.array_distinct(F.slice(grams, one, F.greatest(F.size(grams) - window + 1, one))).alias(out))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def positions(fingerprint: Column) -> Column:
    """Word position, from 0, of each chosen k-gram."""
    low = (1 << POSITION_BITS) - 1
    return F.transform(fingerprint, lambda x: F.lit(low) - x.bitwiseAND(F.lit(low)) - 1)


def as_text(fingerprint: Column) -> Column:
    """``hash@position`` of each choice, in text order, joined by spaces."""
    low = (1 << POSITION_BITS) - 1
    return F.array_join(
        F.transform(fingerprint, lambda x: F.concat(
            F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))), F.lit("@"), (F.lit(low) - x.bitwiseAND(F.lit(low)) - 1).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def in_ranges(docs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``docs`` with ``cell``: ranges of descending ``doc_id`` of about
    ``rows_per_cell`` rows each, between approximate quantiles of the ids.

    Null ids are one range below all others.
    """
    n = cells(docs.where("doc_id is not null").count(), rows_per_cell)
    limits = []
    if n > 1:
        # The rank of a limit is wrong by a quarter of a range at most.
        shares = ", ".join(f"{i / n!r}D" for i in range(1, n))
        limits = sorted(set(docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 4 * n)})")).first()[0]))
    # Limits not over the id, by binary search: at most 65535 are held.
    cell = F.lit(len(limits))
    if limits:
        held = F.split(F.lit(",".join(map(str, limits))), ",").cast("array<long>")
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(limits).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda at, b: F.when((at + b <= len(limits)) & (F.try_element_at(held, at + b) <= F.col("doc_id")), at + b).otherwise(at))
        cell = F.lit(len(limits)) - below
    return docs.withColumn("cell", F.when(F.col("doc_id").isNull(), F.lit(len(limits) + 1)).otherwise(cell).cast("int"))


def with_next(docs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``docs`` with the document that follows each, in descending ``doc_id``.

    Adds ``next_text``, ``next_fp`` from ``text``, ``fp``; the first document
    follows the last.  Documents are dealt once, into ranges of ids that hold about
    ``rows_per_cell`` each; the first document of a range is also dealt to the
    range before it, so a window inside each range sees every successor.
    Rows that share an id follow each other in order of their text's MD5; null
    ids come last.
    """
    docs = in_ranges(docs, rows_per_cell).withColumn("tie", F.md5(F.coalesce("text", F.lit(""))))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    # The first row of each range, as numbers only: at most 65537 rows.  The
    # complement puts ids in descending order without leaving their range.
    heads = docs.groupBy("cell").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("at"), "tie")).alias("head"))
    one = Window.partitionBy(F.lit(0)).orderBy("cell")
    heads = heads.withColumn("to", F.coalesce(F.lag("cell").over(one), F.max("cell").over(Window.partitionBy(F.lit(0))))).select(
        F.col("cell").alias("from"), "to", F.col("head.at").alias("at"), F.col("head.tie").alias("head_tie")
    )
    copies = docs.join(F.broadcast(heads), F.expr("cell = from and ~doc_id <=> at and tie = head_tie"))
    copies = copies.withColumn("cell", F.col("to")).drop("from", "to", "at", "head_tie")
    both = docs.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    w = Window.partitionBy("cell").orderBy("copy", *order)
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("copy = 0").drop("copy", "cell", "tie")


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Returns ``doc_id``, ``n_chars``, ``edited_text``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``; a row for each row.
    In the edited text the last ``n_chars // 2`` code points give way to the
    first as many of the next document, or all it has.  Null text is empty.  An
    empty corpus has no rows; a single document follows itself.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = with_next(with_fingerprint(base, "text", "fp", k, window), rows_per_cell)
    base = base.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    base = base.withColumn("edited_text", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half.cast("int"))))
    base = with_fingerprint(base, "edited_text", "edited_fp", k, window)
    base = base.withColumn("a", hashes(F.col("fp"))).withColumn("b", hashes(F.col("edited_fp"))).withColumn("c", hashes(F.col("next_fp")))
    return base.select(
        "doc_id", "n_chars", "edited_text", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
