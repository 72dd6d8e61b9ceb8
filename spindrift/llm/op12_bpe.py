"""Byte-pair encoding of whole texts and decoding back to vocabulary strings.

A word's bytes are a doubly linked list of symbols.  Neighbours that can merge
wait in a priority queue by the rank of their merge, then by place; an entry
whose symbols have changed since is skipped.  Vocabulary and merges come from a
tokenizer file, of which only the JSON is read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices

#: Words that a Python worker remembers at once, none of them long.
WORDS_KEPT, LONGEST_KEPT = 1_000_000, 64

#: Bits of a symbol in a pair, and of a place in an entry of the queue.
ID_BITS, PLACE_BITS = 20, 32
PLACE_MASK = (1 << PLACE_BITS) - 1
LITTLE = sys.byteorder == "little"

ENCODED = "doc_id long, ids binary, decoded string"

#: The one kind of file that is read (fixed values of its format).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PRE_TOKENIZERS = ["Split", "ByteLevel"]

#: What keeps a text from being lower-cased whole: marks, which NFC may join with
#: a letter of one case alone, and a sigma, whose lower case Python takes from its
#: place.  The name of a special token is left as it is, too.
_APART = regex.compile(r"\p{M}|Σ")
#: Python also splits at these, which aren't white space.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\p{White_Space}+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is one,
    else the next free code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own, free = set(printable), iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a tokenizer file.

    Reads files whose texts are brought to NFC, lower-cased, cut by a pattern and
    taken as bytes, with a suffix at word ends and no decoder; others raise
    ``ValueError``.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model = found["model"]
        steps, cuts = (found[k] or {} for k in ("normalizer", "pre_tokenizer"))
        steps, cuts = steps.get("normalizers", []), cuts.get("pretokenizers", [])
        suffix = model.get("end_of_word_suffix")
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not suffix or not plain or found["decoder"] or [x["type"] for x in steps] != _NORMALIZERS or [x["type"] for x in cuts] != _PRE_TOKENIZERS:
            raise ValueError(f"{path} is no file of the kind that this reads")
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.parts = regex.compile(cuts[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.strings = {i: s for s, i in (ids | self.special).items()}
        symbols = _byte_symbols()
        self.inner, self.last = [ids[s] for s in symbols], [ids[s + suffix] for s in symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: Rank of a merge by both symbols in one number, and what each rank makes.
        self.ranks, self.makes = {}, []
        for a, b in pairs:
            self.ranks[(ids[a] << ID_BITS) | ids[b]] = len(self.makes)
            self.makes.append(ids[a + b])


def merged(symbols: list[int], ranks: dict[int, int], makes: list[int]) -> list[int]:
    """``symbols`` after all merges, the lowest rank first, the leftmost among equals.

    A queue entry is one number, rank before place.
    """
    n, rank_of = len(symbols), ranks.get
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    queue = []
    for i in range(n - 1):
        rank = rank_of((symbols[i] << ID_BITS) | symbols[i + 1])
        if rank is not None:
            queue.append((rank << PLACE_BITS) | i)
    heapify(queue)
    while queue:
        first = heappop(queue)
        rank, i = first >> PLACE_BITS, first & PLACE_MASK
        j = after[i]
        # Stale if a side has been merged since (a symbol that is gone is -1) or was the last.
        if j == n or rank_of((symbols[i] << ID_BITS) | symbols[j]) != rank:
            continue
        new = symbols[i] = makes[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of((new << ID_BITS) | symbols[k])
            if rank is not None:
                heappush(queue, (rank << PLACE_BITS) | i)
        h = before[i]
        if h >= 0:
            rank = rank_of((symbols[h] << ID_BITS) | new)
            if rank is not None:
                heappush(queue, (rank << PLACE_BITS) | h)
    return [s for s in symbols if s >= 0]


class Coder:
    """Encodes and decodes; remembers words and their parts, which never changes a
    result."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT) -> None:
        self.vocabulary, self.words_kept = Vocabulary(path), words_kept
        self.known: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of a part: a stretch of letters, a digit, or other signs."""
        raw, v = part.encode("utf-8"), self.vocabulary
        ids = _packed(merged([*map(v.inner.__getitem__, raw[:-1]), v.last[raw[-1]]], v.ranks, v.makes))
        if len(part) <= LONGEST_KEPT:
            self.known[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word, which holds no white space."""
        v, known = self.vocabulary, self.known
        if word.isascii() and word.isalpha() and word.islower():
            return self._part(word)
        ids = b""
        # Special tokens are found in the word as it is; they come at odd places.
        for i, piece in enumerate(v.specials.split(word) if v.specials else [word]):
            if i % 2:
                ids += _packed([v.special[piece]])
                continue
            piece = unicodedata.normalize("NFC", piece)
            # Each letter by itself: a sigma at a word's end is one like any other.
            piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()
            for part in v.parts.findall(piece):
                ids += known.get(part) or self._part(part)
        if len(word) <= LONGEST_KEPT:
            known[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers.  No token
        spans white space."""
        known = self.known
        if len(known) > self.words_kept:
            known.clear()
        if "<|" not in text and (text.isascii() or not _APART.search(text)):
            text = text.lower()
        words = _SPACE.split(text) if any(c in text for c in _CONTROLS) else text.split()
        get, word = known.get, self._word
        return b"".join([get(w) or word(w) for w in words])

    def encode(self, text: str) -> list[int]:
        return _unpacked(self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The ids' vocabulary strings, word-end suffix and all, joined by spaces:
        the file names no decoder that would do more."""
        return " ".join(map(self.vocabulary.strings.__getitem__, ids))


def _unpacked(ids: bytes) -> array:
    out = array("I", ids)
    if not LITTLE:
        out.byteswap()
    return out


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if not LITTLE:
        out.byteswap()
    return out.tobytes()


@lru_cache(1)
def coder(path: str) -> Coder:
    """One for each Python worker: later tasks find its words remembered."""
    return Coder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (token ids as little-endian unsigned 32-bit numbers in
    a row), ``decoded`` (their vocabulary strings joined by spaces) of each row.

    ``path`` names a tokenizer file that every executor can read.  Null and empty
    texts have no ids and decode to an empty string.  Ids may be null or repeat:
    each row is a document.  Other columns are ignored; no rows in, none out.
    Nothing is shuffled, and a text is held whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in slices(batches):
            ids = [code.packed(text or "") for text in batch.column(1).to_pylist()]
            decoded = [code.decode(_unpacked(i)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)
