"""Best-fit packing of token pieces into sequences by bin completion.

Tasks tokenize and cut texts; the corpus is then only a count of pieces for each
length (at most ``capacity`` rows, whatever the number of documents), and that
is packed as a whole: around the largest remaining length, branch and bound
looks for the best undominated filling, and a filling is used as often as its
lengths allow.  Pieces get their rank among those of their length from two-level
counts and look their place up in the plan, so no task sees a whole length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import cells, running_offsets, written

CAPACITY = 2048
END_ID = 0
ROWS_PER_CELL = 20_000
#: Fillings tried around one largest piece before the best so far is taken.
SEARCH_STEPS = 2_000
#: Words remembered by a Python worker; the memory it takes is bounded by this.
WORDS_KEPT = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The vocabulary never joins letters with punctuation, so these parts can be
#: encoded apart.  An apostrophe may belong to the letters after it.
_ENDS = re.compile(rb"([a-z]+)([.,!?;:#$%&*]+)")


class _Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, drops white space, and no token spans it, so a
    text's ids are its words' ids in a row; words are encoded once and
    remembered while there is room.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), {}

    def _encode(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)):
                into[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        # A special token's name in capitals is no special token: left as it is.
        split = [(raw if b"<|" in raw else raw.translate(_LOWER)).split() for raw in (t.encode("utf-8") for t in texts)]
        known = self.words
        new = {w for words in split for w in words if w not in known}
        ends = {w: m.groups() for w in new if (m := _ENDS.fullmatch(w))}
        whole = {w for w in new if w not in ends} | {x for pair in ends.values() for x in pair if x not in known}
        if len(known) + len(new) + len(whole) > WORDS_KEPT:  # full: these are remembered for this batch only
            known = {w: known[w] for words in split for w in words if w in known} | {x: known[x] for pair in ends.values() for x in pair if x in known}
        self._encode(list(whole), known)
        for w, (a, b) in ends.items():
            known[w] = known[a] + known[b]
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    """One for each Python worker: later tasks find its words remembered."""
    return _Encoder(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each piece.

    A document is its ids and then id 0, so null and empty texts are one piece
    of one token.  Only documents over ``capacity`` are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), width)):
                        part = ids[lo : lo + width]
                        for column, x in zip(out, (doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


@dataclass
class Plan:
    """For each length, ranges of ranks and where they go.

    A range of a filling used ``m`` times with ``c`` pieces of the length holds
    ``m * c`` ranks; rank ``r`` goes to sequence ``base + r // c``.
    """

    starts: dict[int, list[int]] = field(default_factory=dict)
    places: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # base, c, offset
    sequences: int = 0

    def add(self, filling: list[tuple[int, int]], times: int, used: dict[int, int]) -> None:
        offset = 0
        for length, c in filling:
            self.starts.setdefault(length, []).append(used.get(length, 0))
            self.places.setdefault(length, []).append((self.sequences, c, offset))
            used[length] = used.get(length, 0) + c * times
            offset += c * length
        self.sequences += times

    def place(self, length: int, rank: int) -> tuple[int, int]:
        k = bisect_right(self.starts[length], rank) - 1
        base, c, offset = self.places[length][k]
        r = rank - self.starts[length][k]
        return base + r // c, offset + r % c * length


def _best_fit(lengths: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Largest that fits, again and again: the first incumbent."""
    out, i = [], bisect_right(lengths, room) - 1
    while room and i >= 0:
        c = min(left[lengths[i]], room // lengths[i])
        if c:
            out.append((lengths[i], c))
            room -= c * lengths[i]
        i = min(i - 1, bisect_right(lengths, room) - 1)
    return out


def complete(lengths: list[int], left: dict[int, int], room: int, steps: int = SEARCH_STEPS) -> list[tuple[int, int]]:
    """The filling of ``room`` with least waste that branch and bound finds.

    ``lengths`` ascending.  A branch takes pieces in descending length.  It is
    cut when the rest can't bring its waste below the incumbent's.  A filling
    is dominated, and not tried, if a piece left out still fits: each branch
    ends only when nothing fits.  Among equal wastes the one with larger (so
    fewer) pieces comes first.
    """
    best = _best_fit(lengths, left, room)
    waste = room - sum(n * c for n, c in best)
    if not waste:
        return best
    smaller = [0]  # total of all pieces up to each length
    for n in lengths:
        smaller.append(smaller[-1] + n * left[n])
    taken: list[tuple[int, int]] = []
    tried = 0

    def branch(i: int, room: int) -> bool:
        """Lengths up to place ``i`` may still be used; True ends the search."""
        nonlocal best, waste, tried
        tried += 1
        i = min(i, bisect_right(lengths, room) - 1)
        while i >= 0 and not left[lengths[i]]:
            i -= 1
        if i < 0:
            if room < waste:
                best, waste = list(taken), room
            return not waste
        while i >= 0 and tried < steps:
            if room - smaller[i + 1] >= waste:  # all that may be added wastes as much
                return False
            n = lengths[i]
            for c in range(min(left[n], room // n), 0, -1):
                taken.append((n, c))
                done = branch(i - 1, room - c * n)
                taken.pop()
                if done:
                    return True
                if tried >= steps:
                    return False
            i -= 1
        return False

    branch(len(lengths) - 1, room)
    return best


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> Plan:
    """Sequences for ``counts`` pieces of each length.

    The largest remaining piece is completed as well as possible and the filling
    used as often as its pieces last, so each round uses up at least one length
    and there are at most as many rounds as lengths.
    """
    plan, used = Plan(), {}
    left = {n: c for n, c in counts.items() if c > 0}
    while left:
        largest = max(left)
        left[largest] -= 1
        lengths = sorted(n for n, c in left.items() if c)
        rest = complete(lengths, left, capacity - largest, steps)
        left[largest] += 1
        filling = {largest: 1}
        for n, c in rest:
            filling[n] = filling.get(n, 0) + c
        times = min(left[n] // c for n, c in filling.items())
        plan.add(sorted(filling.items(), reverse=True), times, used)
        for n, c in filling.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, steps: int = SEARCH_STEPS, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Pieces of all documents and their places.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``; a row for each piece.  Null and empty texts are
    one piece of length 1.  Ids may be null or repeat; each row is a document.
    No rows in, none out.  Other columns are ignored.
    """
    pieces = written(tokenized_pieces(docs, tokenizer_path, capacity), "pieces")
    n = cells(pieces.count(), rows_per_cell)
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    totals = pieces.groupBy("length", "cell").agg(F.count("*").alias("rows"))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("rows").alias("n")).collect()}  # at most `capacity` rows
    plan = pieces.sparkSession.sparkContext.broadcast(plan_packing(counts, capacity, steps))  # at most `capacity` fillings
    ahead = running_offsets(totals, ["length"], "cell", "rows", "ahead").select("length", "cell", "ahead")
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(ahead, ["length", "cell"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth") - 1).alias("rank")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [plan.value.place(n, r) for n, r in zip(batch["length"].tolist(), batch["rank"].tolist())]
            out = batch.drop(columns="rank")
            out["sequence_id"] = np.array([x[0] for x in at], "int64")
            out["offset"] = np.array([x[1] for x in at], "int64")
            yield out

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
