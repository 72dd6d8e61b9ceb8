"""Substring dedup with compressed FM-indexes over content-defined shards.

Comparing every document with every shard would cost as the square of the
corpus.  Here windows of ``window`` words go to shards by their content: each
window has a minimizer (its least hashed ``K``-gram, the anchor), consecutive
windows with the same one form a segment, and equal windows always meet in their
anchor's shard.  Anchors seen once hold nothing that repeats and stop there;
equal segments are pre-aggregated to their first place.  What differs under one
anchor is indexed: a shard's segments become an FM-index over word ids, and are
streamed against it; backward search through its wavelet tree gives matching
statistics, and each window that reaches the threshold is reported with its range,
in which the earliest place is kept.

An anchor with very many different segments (the rim of a passage that a third
of all documents hold) would outgrow its shard: its windows are spread by their
own hash instead and pre-aggregated there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, slices
from spindrift.llm.fm_index import FMIndex
from spindrift.llm.words import Spans, mixed, rolled, word_hashes

WINDOW = 20
K = 6
SHARD_SEGMENTS = 20_000
#: Different segments of one anchor beyond which its windows are spread.
SPREAD = 2_000

def segments(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash, start and number of windows of each segment of a text.

    Among equal k-grams of a window the leftmost is its minimizer, so a window's
    content alone decides its anchor and the place of it.
    """
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 4
    k = min(K, window)
    grams = rolled(hashes, k)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
    at += np.arange(len(at))
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(at)]]))
    return grams[at[starts]].view(np.int64), Spans(hashes).of(starts, counts + window - 1).view(np.int64), starts, counts


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


_SEGMENT = "anchor long, seg long, doc_id long, tie int, start int, n int"
_FOUND = "doc_id long, tie int, start int, n int"


def all_segments(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            parts, ids, ties = [], [], []
            for doc_id, tie, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(segments(word_hashes((text or "").encode("utf-8")), window))
                ids.append(np.full(len(parts[-1][0]), doc_id, np.int64))
                ties.append(np.full(len(parts[-1][0]), tie, np.int32))
            anchor, seg, start, n = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seg), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ties)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "seg", "doc_id", "tie", "start", "n"])

    return docs.where("doc_id is not null").select("doc_id", "tie", "text").mapInArrow(run, _SEGMENT)


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of each wanted segment: ``wanted`` has an array of places for
    each document, so a document is read once."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for doc_id, tie, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                for p in places:
                    out.append((p["anchor"], doc_id, tie, p["start"], p["n"], p["spread"], b" ".join(words[p["start"] : p["start"] + p["n"] + p["more"]]).decode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))],
                ["anchor", "doc_id", "tie", "start", "n", "spread", "words"],
            )

    return docs.join(wanted.hint("merge"), ["doc_id", "tie"]).select("doc_id", "tie", "text", "places").mapInArrow(run, "anchor long, doc_id long, tie int, start int, n int, spread boolean, words string")


def _search_shard(window: int):
    """Windows of a shard's segments that occur earlier in another of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids: dict[bytes, int] = {}
        coded = [[ids.setdefault(w, len(ids) + 1) for w in x.encode("utf-8").split(b" ")] for x in rows["words"]]
        lengths = np.array([len(c) for c in coded])
        text = np.array([x for c in coded for x in (*c, 0)], np.int64)  # 0 ends each segment
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        index = FMIndex(text, len(ids) + 1, window)
        n = rows["n"].to_numpy()
        owner = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        _, name = index.matching_statistics(text, begin[owner] + offset + window - 1, window)
        found = np.flatnonzero(name >= 0)
        doc_id, tie, start = rows["doc_id"].to_numpy()[owner[found]], rows["tie"].to_numpy()[owner[found]], rows["start"].to_numpy()[owner[found]] + offset[found]
        order = np.lexsort((start, tie, doc_id, name[found]))
        named = name[found][order]
        later = order[1:][named[1:] == named[:-1]]  # all but the earliest of each range
        return pd.DataFrame({"doc_id": doc_id[later], "tie": tie[later], "start": start[later].astype("int32"), "n": np.ones(len(later), "int32")})

    return run


def _spread_windows(cut: DataFrame, window: int) -> DataFrame:
    """Each window of the segments with two hashes of its words."""

    def run(batches):
        for batch in slices(batches):
            parts = []
            for doc_id, tie, start, n, words in zip(*(c.to_pylist() for c in batch.columns)):
                h = word_hashes(words.encode("utf-8"))
                at, size = np.arange(n), np.full(n, window)
                parts.append((Spans(h).of(at, size).view(np.int64), Spans(mixed(h)).of(at, size).view(np.int64), np.full(n, doc_id), np.full(n, tie, np.int32), (start + at).astype(np.int32)))
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc_id", "tie", "start"])

    return cut.select("doc_id", "tie", "start", "n", "words").mapInArrow(run, "h1 long, h2 long, doc_id long, tie int, start int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS, spread: int = SPREAD) -> DataFrame:
    """``doc_id``, ``tie``, ``start``, ``n``: runs of ``n`` windows from word
    ``start`` that all occur earlier (in a smaller id, or tie of the same id, or
    further left in the same document).

    ``docs`` has ``doc_id`` long, ``tie`` int and ``text``; documents of the same
    id and tie have the same text.
    """
    scratch = Scratch(docs.sparkSession)
    seen = all_segments(docs, window)
    # What is joined to rows of a hot anchor is written first: the adaptive skew
    # join splits only what comes straight from a shuffle.
    again = scratch.put(seen.groupBy("anchor").agg(F.count("*").alias("held")).where("held > 1").select("anchor"), "anchors")
    hits = scratch.put(seen.join(again.hint("merge"), "anchor"), "segments")
    place = F.struct("doc_id", "tie", "start")
    distinct = scratch.put(hits.groupBy("anchor", "seg").agg(F.min(place).alias("first"), F.max("n").alias("n")), "distinct")
    earlier = hits.join(distinct.select("anchor", "seg", "first").hint("merge"), ["anchor", "seg"])
    copies = scratch.put(earlier.where(place != F.col("first")).select("doc_id", "tie", "start", "n"), "copies")
    scratch.drop("anchors", "segments")

    kinds = scratch.put(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    wanted = distinct.join(kinds.hint("merge"), "anchor").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie"),
        F.struct("anchor", F.col("first.start").alias("start"), "n", (F.col("kinds") > spread).alias("spread"), F.lit(window - 1).alias("more")).alias("place"))
    wanted = wanted.groupBy("doc_id", "tie").agg(F.collect_list("place").alias("places"))  # a document's own segments
    cut = _cut_out(docs, wanted).dropDuplicates(["anchor", "doc_id", "tie", "start"])  # repeated rows have one place
    cut = scratch.put(cut, "cut")
    scratch.drop("distinct", "kinds")

    shards = max(1, -(-cut.where("not spread").count() // shard_segments))
    indexed = cut.where("not spread").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    differing = indexed.groupBy("shard").applyInPandas(_search_shard(window), _FOUND)
    windows = _spread_windows(cut.where("spread"), window)
    first = scratch.put(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("held")).where("held > 1"), "common")
    common = windows.join(first.hint("merge"), ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "tie", "start", F.lit(1).alias("n"))
    return copies.union(differing).union(common)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS, spread: int = SPREAD) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` for every row.

    Words are runs of other characters than space and tab to carriage return,
    unchanged.  A word is removed if a window of ``window`` consecutive words that
    covers it also starts earlier: in a smaller ``doc_id``, or further left in
    the same document.  Windows are judged on the input.  ``kept`` is the other
    words joined by one space.  Null and empty texts have no words.  Rows that
    share an id are documents of their own, earlier and later by a hash of the
    text; if their texts are equal too they are one document and lose the
    same.  A row with a null id is neither compared nor cut.  No rows in, none
    out.  Other columns are ignored.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**31 - 1)).cast("int")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), "text")
    runs = repeated_windows(base, window, shard_segments, spread)
    gone = runs.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(batches):
        for batch in slices(batches):
            out = ([], [], [], [])
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        if r["start"] < len(words):
                            edge[r["start"]] += 1
                            edge[min(r["start"] + r["n"] + window - 1, len(words))] -= 1
                    kept = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
                else:
                    kept = words
                for column, x in zip(out, (doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8"))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept"])

    return base.join(gone.hint("merge"), ["doc_id", "tie"], "left").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


