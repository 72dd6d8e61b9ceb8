"""Line dedup with two Bloom filters.

Each task puts its keys into a filter of hashes seen once and a filter of hashes
seen twice, in segments.  Segments of all tasks are merged by streaming over
them: ``twice |= other.twice | (once & other.once); once |= other.once``.  The
merged second filter has a bounded size and goes to all tasks; only keys that
it holds are shuffled, to be counted exactly by SHA-256 of the key and to choose
the document that keeps them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, slices

MIN_CHARS = 20
MIN_DOCS = 3
#: Bits of each filter.  A fuller filter lets more keys through to the exact
#: count; it never loses one.
MIN_BITS, MAX_BITS = 1 << 22, 1 << 27
SEGMENT_BITS = 1 << 19
HASHES = 3

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where it is too short to count."""
    keys: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(_SPACE).translate(_LOWER)
        # A code point has at most four bytes, and continuation bytes don't count.
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
            keys.append(None)
        else:
            keys.append(key)
    return keys


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``HASHES`` bit positions, all in one segment, for each hash."""
    segments = np.uint64(bits // SEGMENT_BITS)
    within = np.uint64(SEGMENT_BITS - 1)
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    base = (hashes % segments) * np.uint64(SEGMENT_BITS)
    mix = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([base + ((mix + np.uint64(i) * step * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40) & within) for i in range(HASHES)], axis=1)


def _hashes(keys: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class _Pair:
    """The two filters, as bytes of bits by segment."""

    def __init__(self, bits: int) -> None:
        self.bits, self.once, self.twice = bits, {}, {}

    def merge(self, segment: int, once: np.ndarray, twice: np.ndarray) -> None:
        if segment in self.once:
            self.twice[segment] |= twice | (self.once[segment] & once)
            self.once[segment] |= once
        else:
            self.once[segment], self.twice[segment] = once.copy(), twice.copy()

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of one document, each once."""
        at = _positions(hashes, self.bits)
        for segment in np.unique(at[:, 0] // SEGMENT_BITS).tolist():
            mine = at[at[:, 0] // SEGMENT_BITS == segment] % SEGMENT_BITS
            once = self.once.setdefault(segment, np.zeros(SEGMENT_BITS // 8, np.uint8))
            twice = self.twice.setdefault(segment, np.zeros(SEGMENT_BITS // 8, np.uint8))
            byte, bit = mine >> np.uint64(3), (np.uint64(1) << (mine & np.uint64(7))).astype(np.uint8)
            seen = ((once[byte] & bit) != 0).all(axis=1)
            np.bitwise_or.at(twice, byte[seen].ravel(), bit[seen].ravel())
            np.bitwise_or.at(once, byte.ravel(), bit.ravel())

    def rows(self) -> pd.DataFrame:
        pack = lambda x: zlib.compress(x.tobytes(), 1)
        return pd.DataFrame({
            "segment": pd.Series(list(self.once), dtype="int32"),
            "once": [pack(x) for x in self.once.values()], "twice": [pack(self.twice[k]) for k in self.once],
        })


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8)


def twice_seen(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """``segment``, ``twice``: the merged filter of keys that two documents may hold."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _Pair(bits)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if keys := {k for k in line_keys(text, min_chars) if k is not None}:
                    pair.add(_hashes(keys))
        yield pa.RecordBatch.from_pandas(pair.rows(), preserve_index=False, schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _Pair(bits)
        for batch in batches:
            for segment, once, twice in batch.itertuples(index=False):
                pair.merge(segment, _unpack(once), _unpack(twice))
        yield pair.rows()[["segment", "twice"]]

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary")
    return parts.repartition("segment").mapInPandas(merge, "segment int, twice binary")


def filter_bits(rows: int) -> int:
    """About 16 bits for each line at 16 lines a row, within the bounds."""
    bits = MIN_BITS
    while bits < MAX_BITS and bits < 256 * rows:
        bits *= 2
    return bits


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS
) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` rewritten and
    ``n_lines``, ``n_dropped`` added.

    A key (the line, stripped and with A-Z lower-cased) of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold loses all
    its lines but those in the largest ``doc_id``.  Null or empty text is one
    empty line and becomes empty.  Rows that share an id count as one document;
    a null id is no document: its lines are neither counted nor dropped.  No
    rows in, none out.  Other columns pass unchanged; input columns named
    ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    bits = min(max_bits, filter_bits(docs.count()))
    # At most max_bits / 8 bytes, whatever the number of documents.
    merged = twice_seen(docs.where("doc_id is not null"), bits, min_chars).collect()
    filters = spark.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in merged})

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.zeros(bits // 8, np.uint8)
        for segment, blob in filters.value.items():
            twice[segment * SEGMENT_BITS // 8 : (segment + 1) * SEGMENT_BITS // 8] = _unpack(blob)
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own := list({k for k in line_keys(text, min_chars) if k is not None}):
                    at = _positions(_hashes(own), bits)
                    hit = ((twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                    for i in np.flatnonzero(hit).tolist():
                        ids.append(doc_id)
                        keys.append(hashlib.sha256(own[i]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    suspect = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(suspects, "doc_id long, key binary").distinct()
    # Written first: the adaptive skew join splits a line that very many documents
    # hold only if what is joined to it comes straight from a shuffle.
    scratch = Scratch(spark)
    suspect = scratch.put(suspect, "suspects")
    keep = scratch.put(suspect.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs), "keepers")
    drop = suspect.join(keep.hint("merge"), "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("__drop"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    both = docs.select(*names).join(drop.withColumnRenamed("doc_id", "__id"), F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_dropped", "long")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, dropped in zip(batch.column("text").to_pylist(), batch.column("__drop").to_pylist()):
                text = text or ""
                lines = text.split("\n")
                if dropped:
                    gone = set(dropped)
                    kept = [x for x, k in zip(lines, line_keys(text, min_chars)) if k is None or hashlib.sha256(k).digest() not in gone]
                    texts.append("\n".join(kept))
                    n_dropped.append(len(lines) - len(kept))
                else:
                    texts.append(text)
                    n_dropped.append(0)
                n_lines.append(len(lines))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return both.mapInArrow(rewrite, schema)
