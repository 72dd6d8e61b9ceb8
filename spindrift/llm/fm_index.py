"""A compressed FM-index over a small alphabet of integers, in NumPy.

The Burrows-Wheeler transform is kept as a wavelet tree in matrix layout: one bit
vector a level, packed in 64-bit words with a running count for each word.  All
queries are answered for many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (at least), by doubling.

    Backward search for patterns of up to ``depth`` symbols needs no more.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - known)] = rank[known:] + 1
        key = rank * np.int64(n + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        known *= 2
        if rank[order[-1]] == n - 1:  # all differ
            break
    return order


class FMIndex:
    """Index of ``text``, symbols 0 to ``sigma - 1``."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        self.n = len(text)
        bwt = text[suffix_order(text, depth) - 1].astype(np.uint32)  # what precedes each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))
            self.zeros.append(int(self.n - ones.sum()))
            row = np.concatenate([row[~bit], row[bit]])
        symbols = np.arange(sigma)
        #: Added to a mapped position to give the row of the longer pattern.
        self.base = self.first[:-1] - self._mapped(symbols, np.zeros(sigma, np.int64))

    def _mapped(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions followed down the tree along the bits of ``symbols``."""
        for depth in range(self.levels):
            bit = (symbols >> (self.levels - 1 - depth)) & 1
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[depth][word].astype(np.int64) + np.bitwise_count(self.words[depth][word] & below)
            at = np.where(bit == 1, self.zeros[depth] + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with a symbol and what the given ranges start with."""
        base = self.base[symbols]
        return base + self._mapped(symbols, low), base + self._mapped(symbols, high)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search from each place in ``ends`` (inclusive).

        ``text`` is streamed against the index in batches.  Returns how many
        symbols match something besides the query's own occurrence, up to
        ``threshold``, and for those that reach it the first row of their range,
        which names the matched sequence (-1 for others).
        """
        length, name = np.zeros(len(ends), np.int32), np.full(len(ends), -1, np.int64)
        for lo in range(0, len(ends), 1 << 17):
            live = np.arange(lo, min(lo + (1 << 17), len(ends)))
            low, high = self.first[text[ends[live]]], self.first[text[ends[live]] + 1]
            for step in range(1, threshold + 1):
                if step > 1:
                    low, high = self.extend(text[ends[live] - (step - 1)], low, high)
                repeats = high - low > 1
                live, low, high = live[repeats], low[repeats], high[repeats]
                length[live] = step
                if not len(live):
                    break
            name[live] = low
        return length, name
