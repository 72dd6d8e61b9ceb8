"""Words of a text as 64-bit hashes, in NumPy arrays."""

from __future__ import annotations

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each number spread over all of it."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of any runs of a sequence of numbers, from one running sum.

    Equal runs have equal hashes wherever they stand.
    """

    #: Powers are kept for sequences up to this length.
    KEPT = 1 << 16
    _up, _down = powers(_BASE, KEPT), powers(_INVERSE, KEPT)

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        up, self.down = (self._up[:n], self._down[:n]) if n <= self.KEPT else (powers(_BASE, n), powers(_INVERSE, n))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * up, dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + lengths.astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a text, in order.

    Words are runs of other bytes than space and tab to carriage return.
    """
    a = np.frombuffer(raw, np.uint8)
    edge = np.zeros(len(a) + 2, np.int8)
    edge[1:-1] = ~_SPACE[a]
    edge = np.diff(edge)
    starts = np.flatnonzero(edge == 1)
    return Spans(_BYTE[a]).of(starts, np.flatnonzero(edge == -1) - starts)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-cased (A-Z) word ``k``-grams.

    With fewer words the whole sequence is one shingle; without words, none.
    """
    words = word_hashes((text or "").encode("utf-8").translate(LOWER))
    if not len(words):
        return np.zeros(0, np.int64)
    return distinct(rolled(words, min(k, len(words)))).view(np.int64)
