"""Periodic runs of words by the runs theorem.

Every maximal repetition has a Lyndon root that is the longest Lyndon word at its
place, in the order of words or in the reverse one.  That word ends before the
next suffix that is smaller, so next-smaller and next-greater values of the
inverse suffix array name at most two candidates a word.  A candidate is
extended to the right by the longest common prefix of two suffixes, the least
value between them in the LCP array by a sparse table, and to the left by the
same on the reversed words.

Many documents share one suffix array: each ends with a symbol of its own, which
no run can contain.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices

#: Words that share a suffix array; a longer document has one of its own.
WORDS_AT_ONCE = 1 << 16
LEAST_LENGTH, LEAST_POWER = 6, 4

FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


class Suffixes:
    """Suffix array, its inverse and LCP queries of symbols whose last is unique."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.ones(n, bool)
        np.not_equal(symbols[order[1:]], symbols[order[:-1]], out=head[1:])
        rank = np.empty(n, np.int64)
        rank[order] = _heads(head)
        levels, width = [], 1
        alone = head & np.append(head[1:], True)
        at = order[~alone]
        # Doubling: only suffixes that share their first `width` symbols are sorted on.
        while len(at):
            levels.append(rank.astype(np.int32))
            old = rank[at]
            key = old * n + rank[at + width]
            turn = np.argsort(key, kind="stable")
            at, key, old = at[turn], key[turn], old[turn]
            group, part = np.ones(len(at), bool), np.ones(len(at), bool)
            np.not_equal(old[1:], old[:-1], out=group[1:])
            np.not_equal(key[1:], key[:-1], out=part[1:])
            begins = _heads(group)
            order[old + np.arange(len(at)) - begins] = at
            rank[at] = old + _heads(part) - begins
            at = at[~(part & np.append(part[1:], True))]
            width *= 2
        self.rank = rank
        # What neighbours in the array share, the widest level first.
        lcp = np.zeros(n, np.int32)
        pairs = np.flatnonzero(~head)
        a, b = order[pairs - 1], order[pairs]
        shared = np.zeros(len(pairs), np.int64)
        for k in reversed(range(len(levels))):
            shared += (levels[k][a + shared] == levels[k][b + shared]).astype(np.int64) << k
        lcp[pairs] = shared
        self.table = _least(lcp)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``, all different."""
        p, q = self.rank[a], self.rank[b]
        low, high = np.minimum(p, q) + 1, np.maximum(p, q) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            of = k == level
            out[of] = np.minimum(self.table[level][low[of]], self.table[level][high[of] - (1 << int(level))])
        return out


def _heads(first: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where ``first`` holds."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Least value of every window whose width is a power of two."""
    table = [values]
    while 1 << len(table) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the next smaller value, or the length where none follows.

    Most are near: a few steps first, then descents in a table of least values.
    """
    n = len(values)
    out = np.full(n, n, np.int64)
    left = np.arange(n)
    for step in range(1, 17):
        left = left[left + step < n]
        found = values[left + step] < values[left]
        out[left[found]] = left[found] + step
        left = left[~found]
    if len(left):
        table, at, own = _least(values), left + 17, values[left]
        for k in reversed(range(len(table))):
            inside = at + (1 << k) <= n
            skip = np.zeros(len(at), bool)
            skip[inside] = table[k][at[inside]] > own[inside]
            at = at + (skip.astype(np.int64) << k)
        out[left] = np.minimum(at, n)
    return out


def runs(symbols: np.ndarray, documents: np.ndarray, lengths: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> np.ndarray:
    """Rows of ``start``, ``length``, ``period`` in order, starts in ``symbols``.

    ``symbols`` holds documents of ``lengths`` (each with its closing symbol),
    ``documents`` the number of each symbol's document.  Runs are at least
    ``least_length`` long and ``least_power`` (2 or more) periods.
    """
    suffixes = Suffixes(symbols)
    n = len(symbols)
    here = np.arange(n)
    roots = []
    for order in (suffixes.rank, -suffixes.rank):
        period = next_smaller(order) - here
        fits = here + period < n
        fits[fits] = symbols[here[fits]] == symbols[here[fits] + period[fits]]
        start = here[fits]
        shared = suffixes.common(start, start + period[fits])
        # A run's first root begins within its first period, so all but two periods follow.
        keep = shared >= (least_power - 2) * period[fits]
        roots.append(np.stack([start[keep], period[fits][keep], shared[keep]], axis=1))
    start, period, right = np.unique(np.concatenate(roots), axis=0).T
    if not len(start):
        return np.zeros((0, 3), np.int64)
    # The same to the left, on the documents that hold a root, reversed.
    ends = np.cumsum(lengths)
    held = np.unique(documents[start])
    size = lengths[held] - 1
    shift = np.cumsum(size + 1) - (size + 1)
    back = np.repeat(ends[held] - 2, size + 1) - (np.arange((size + 1).sum()) - np.repeat(shift, size + 1))
    back[np.cumsum(size + 1) - 1] = ends[held] - 1  # the closing symbol stays last
    mirrored = Suffixes(symbols[back])
    own = np.searchsorted(held, documents[start])
    mirror = lambda place: shift[own] + ends[held[own]] - 2 - place
    before = start > (ends - lengths)[documents[start]]
    left = np.zeros(len(start), np.int64)
    if before.any():
        a, b = mirror(start - 1), mirror(start + period - 1)
        left[before] = mirrored.common(a[before], b[before])
    length = left + period + right
    long = length >= np.maximum(least_length, least_power * period)
    return np.unique(np.stack([start - left, length, period], axis=1)[long], axis=0)


def _found(words: list[list[bytes]], least_length: int, least_power: int) -> list[np.ndarray]:
    """Runs of each document, starts within it."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(lengths)
    symbols = np.empty(int(ends[-1]), np.int64)
    for w, end in zip(words, ends.tolist()):
        symbols[end - 1 - len(w) : end - 1] = list(map(number.__getitem__, w))
    symbols[ends - 1] = len(number) + np.arange(len(words))
    documents = np.repeat(np.arange(len(words)), lengths)
    found = runs(symbols, documents, lengths, least_length, least_power)
    cuts = np.searchsorted(documents[found[:, 0]], np.arange(1, len(words)))
    begins = ends - lengths
    return [part - np.array([b, 0, 0]) for part, b in zip(np.split(found, cuts), begins.tolist())]


def _row(words: list[bytes], found: np.ndarray) -> tuple:
    """What a document's row holds: the strongest run, all runs, and the words kept."""
    if not len(found):
        return 0, None, None, None, None, "", b" ".join(words).decode("utf-8")
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    rows = sorted((s, q, n) for s, n, q in found.tolist())
    best = rows[0]
    for row in rows[1:]:  # in order of start and period: only a greater quotient goes before
        if row[2] * best[1] > best[2] * row[1]:
            best = row
    start, period, length = best
    return len(rows), start, length, period, 1000 * length // period, "".join(f"{s},{n},{q}\n" for s, q, n in rows), b" ".join(kept).decode("utf-8")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of documents, chosen by a checksum of their id, go over to repeating
    a stretch of their own words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return [words[i] for i in at.tolist()]


def find_runs(
    docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER, at_once: int = WORDS_AT_ONCE
) -> DataFrame:
    """Runs of consecutive words of every document, and its text without repeats.

    Returns for each row ``doc_id``, ``n_runs``; ``start``, ``length``, ``period``,
    ``exponent_milli`` of the run with the greatest length over period (ties: the
    first start, then the smallest period; without a run all four are null);
    ``runs``, a line ``start,length,period`` for every run by start, then period;
    ``collapsed``, the words left, joined by spaces, when those that any run holds
    after its first period are dropped.  ``edit`` may change a document's words
    first.

    Null and empty texts have no words and no runs.  Ids may be null or repeat:
    each row is a document.  Other columns are ignored; no rows in, none out.
    Nothing is shuffled; memory follows the longest document, or ``at_once``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, todo = batch.column(0).to_pylist(), []
            texts = batch.column(1).cast(pa.binary())
            out = []
            size = 0
            for doc_id, text in zip(ids, texts):
                words = (text.as_py() or b"").split()
                todo.append(edit(doc_id, words) if edit else words)
                size += len(words) + 1
                if size >= at_once:
                    out += map(_row, todo, _found(todo, least_length, least_power))
                    todo, size = [], 0
            if todo:
                out += map(_row, todo, _found(todo, least_length, least_power))
            columns = list(zip(*out))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
