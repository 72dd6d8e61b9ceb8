"""N-gram Jaccard join with token-combination prefixes.

A document is a set of word shingles (tokens).  Tokens have one order for the
whole corpus: rare ones first, frequent ones last, by hash within each class.
Two sets of Jaccard similarity t or more share at least ``c`` tokens among the
first ``n - ceil(t * n) + c`` of each (one, for c = 1, where that is enough: where
the first tokens are all rare).  Either one of those is rare, and is
indexed by itself; or all are frequent, and as frequent tokens are dealt to
``c - 1`` groups, two of one group are shared: a pair, indexed as a combination.
Very small sets are indexed by their subsets of the size that they must share.

An entry of a list carries how many tokens the set loses before its place there,
and how many tokens of its prefix no other set lists, which it loses to every set
that is listed as far; these and sizes rule most pairs out inside the list,
exact prefixes most others, and the rest are verified on whole texts.  That is done in two rounds: each
document with the leader of its list, then only those pairs of a list that the
links so far have not connected.  Long lists are cut by set size, a set in two
neighbouring cuts, so that all that may link meet.  The leader is the set whose
lists hold most documents, which among near copies is the one nearest to
what they are copies of.  A list of many near copies thus makes about as many
pairs as it has documents.  Copies of a set are one document throughout.

The second round pairs all of a list only if it is short.  In a long one each
document is described by what differs between it and the leader, r.  If two
linked documents differ from r in nothing shared, both link with r, by the sizes
of the differences; else their differences overlap by a known least number of
tokens, and a prefix of each difference, tokens that r lacks first, is listed.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, slices
from spindrift.llm.components import connected_components
from spindrift.llm.words import mixed, shingle_set

WORDS = 5
THRESHOLD = (80, 100)
#: Tokens that about this many documents hold are frequent, whatever the corpus.
FREQUENT = 64
#: At most so many tokens are treated as frequent: the most frequent ones.
#: Which tokens are decides how fast lists are, never what is found.
FREQUENT_MOST = 1 << 20
#: Tokens counted together, and how many documents must hold one there for it to
#: be passed on.  Both are the same at every size: of a token that is spread
#: evenly some chunk holds so many unless chunks are far more than its documents.
CHUNK, PASSED = 2_000_000, 4
#: Pairs a task holds at most before it passes them on.
PAIRS = 250_000
GROUPS = 4
#: Lists up to this length are paired whole in the second round; longer than
#: those of rare tokens, which :data:`FREQUENT` bounds.
SHORT = 128


def frequent_tokens(docs: DataFrame, k: int) -> DataFrame:
    """``token``, ``n``: tokens that at least about half of :data:`FREQUENT` documents hold.

    All documents are counted, in chunks; what is common in a chunk is summed.
    """

    def count(batches):
        held, size = [], 0

        def common():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= PASSED
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text, k))
                size += len(held[-1])
                if size >= CHUNK:
                    yield common()
                    held, size = [], 0
        if size:
            yield common()

    sums = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= FREQUENT / 2).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """The prefix of a set, in order; the keys under which it is listed; the
    tokens it may lose before each key; how many keys, at the front, are
    the prefix's rare tokens, in order; whether those are all its rare tokens.

    The first token two sets share is at each one's place, so what comes before
    is lost.  Of a combination, at most ``c`` shared tokens come up to its second.
    """
    n, c = len(tokens), GROUPS + 1
    need = -(-n * num // den)  # tokens any partner must share
    often = _among(tokens, frequent)
    n_rare = n - int(often.sum())
    ordered = np.concatenate([tokens[~often], tokens[often]])  # both in order of the unsigned number
    length = n - need + 1
    if n_rare < length:  # a shared token may be a frequent one
        length = min(n, n - need + c)
    singles = ordered[: min(length, n_rare)]
    keys, places = [singles], [np.arange(len(singles))]
    tail = ordered[n_rare:length].view(np.uint64)
    groups = mixed(tail) % np.uint64(GROUPS)
    for g in range(GROUPS):
        at = np.flatnonzero(groups == g)
        if len(at) > 1:
            i, j = np.triu_indices(len(at), 1)
            keys.append(mixed(tail[at[i]] * np.uint64(3) + mixed(tail[at[j]])).view(np.int64))
            places.append(np.maximum(0, n_rare + at[j] - GROUPS))
    if need < c:  # so small a set may share fewer than c
        whole = np.sort(tokens)
        for s in range(need, min(n, c) + 1):
            subsets = [xxhash.xxh3_64_intdigest(np.array(x).tobytes()) for x in combinations(whole.tolist(), s)]
            keys.append(np.array(subsets, np.uint64).view(np.int64))
            places.append(np.zeros(len(subsets), np.int64))
    return ordered[:length], np.concatenate(keys), np.concatenate(places).astype(np.int32), len(singles), len(singles) == n_rare


def _among(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which tokens are in the sorted ``frequent``."""
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens


def profiles(docs: DataFrame, shared, k: int, num: int, den: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``same`` (digest of the set), and what
    :func:`index_keys` gives: ``prefix``, ``keys``, ``places``, ``singles``,
    ``whole``.  ``shared`` is the broadcast array of frequent tokens."""

    def run(batches):
        often, none = shared.value, np.zeros(0, np.int64)
        for batch in slices(batches):
            n, same, found = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, k)
                n.append(len(tokens))
                same.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                found.append(index_keys(tokens, often, num, den) if len(tokens) else (none, none, none.astype(np.int32), 0, True))
            prefix, keys, places, singles, all_rare = zip(*found)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), _lists(prefix), _lists(keys), _lists(places), pa.array(singles, pa.int32()), pa.array(all_rare, pa.bool_()),
            ], ["doc_id", "n", "same", "prefix", "keys", "places", "singles", "whole"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, same binary, prefix array<long>, keys array<long>, places array<int>, singles int, whole boolean")


def _lists(arrays) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays)))


def _listed_up_to(end: np.uint64 | None, x: np.ndarray) -> np.ndarray:
    return x if end is None else x[x <= end]


def most_shared(n: int, x: np.ndarray, rare_x: int, whole_x: bool, m: int, y: np.ndarray, rare_y: int, whole_y: bool) -> int:
    """At most so many tokens two sets of sizes ``n`` and ``m`` share, from their
    prefixes, of which the first ``rare_`` tokens are rare ones: ``whole_`` all.

    Up to the token to which both are listed, shared tokens are known; beyond
    it at most the smaller rest is shared.
    """
    x, y = x.view(np.uint64), y.view(np.uint64)
    a, b = x[:rare_x], y[:rare_y]
    # How far each is listed among the rare tokens; None: to the end.
    ends = [s[-1] for s, all_rare in ((a, whole_x), (b, whole_y)) if not all_rare]
    end = min(ends, default=None)
    a, b = _listed_up_to(end, a), _listed_up_to(end, b)
    known = [len(a), len(b)]
    both = len(np.intersect1d(a, b, assume_unique=True))
    if end is None:
        a, b = x[rare_x:], y[rare_y:]
        ends = [(s[-1] if len(s) else np.uint64(0)) for s, size, listed in ((a, n, len(x)), (b, m, len(y))) if listed < size]
        end = min(ends, default=None)
        a, b = _listed_up_to(end, a), _listed_up_to(end, b)
        known = [known[0] + len(a), known[1] + len(b)]
        both += len(np.intersect1d(a, b, assume_unique=True))
    return both + min(n - known[0], m - known[1])


def plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a``, ``b`` that their prefixes don't rule out.  None of the
    similarity is lost."""
    columns = ("n", "prefix", "singles", "whole")

    def run(batches):
        for batch in batches:
            known = dict(zip(batch.schema.names, batch.columns))
            sides = [[known[f"{c}_{x}"].to_pylist() if c != "prefix" else known[f"{c}_{x}"] for c in columns] for x in "ab"]
            good = []
            for i in range(batch.num_rows):
                (n, x, p, all_x), (m, y, q, all_y) = (tuple(c[i] if j != 1 else c[i].values.to_numpy() for j, c in enumerate(side)) for side in sides)
                good.append((num + den) * most_shared(n, x, p, all_x, m, y, q, all_y) >= num * (n + m))
            yield pa.RecordBatch.from_arrays([known["a"], known["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: sets.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    return pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").mapInArrow(run, "a long, b long")


#: What an entry of a list carries.
MEMBER = ("doc_id", "n", "place", "alone", "last", "part")


def within(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a < b`` of different parts in a list that sizes and places allow.

    ``lists`` has ``members``, at most :data:`SHORT` structs of :data:`MEMBER`,
    and ``first``, the leader: near copies meet in many lists of one leader, so a
    task that holds all of a leader's passes each pair on about once.
    """

    def fitting(columns: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Pairs of each row of places ``at``."""
        i, j = np.triu_indices(at.shape[1], 1)
        (a, n, p, u, x, s), (b, m, q, v, y, t) = ([c[at[:, side].ravel()] for c in columns] for side in (i, j))
        left = np.minimum(np.minimum(n - p, m - q), np.minimum(np.where(x <= y, n - u, n), np.where(y <= x, m - v, m)))
        ok = (s != t) & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((num + den) * left >= num * (n + m))
        return np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]])

    def distinct_pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def run(batches):
        found, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            columns = [lists.flatten().field(c).to_numpy().astype(np.int64) for c in MEMBER]
            lengths = lists.value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for k in np.unique(lengths[lengths > 1]).tolist():
                same = starts[lengths == k]
                step = max(1, PAIRS // (k * k))
                for lo in range(0, len(same), step):
                    found.append(fitting(columns, same[lo : lo + step, None] + np.arange(k)))
                    size += found[-1].shape[1]
                    if size >= PAIRS:
                        yield distinct_pairs(found)
                        found, size = [], 0
        if size:
            yield distinct_pairs(found)

    return lists.repartition("first").select("members").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs ``a``, ``b`` whose whole texts reach the similarity."""

    def run(batches):
        sets = {}

        def tokens(doc_id, text):
            if doc_id not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[doc_id] = shingle_set(text, k)
            return sets[doc_id]

        for batch in slices(batches):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = []
            for p, q, x, y in zip(a, b, ta, tb):
                u, v = tokens(p, x), shingle_set(y, k)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(den * both >= num * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _with_texts(pairs, texts, scratch).mapInArrow(run, "a long, b long")


def _with_texts(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs with both texts.  Joins have one form at every size, so that what
    they shuffle grows with the input and not with a change of plan.  Texts
    asked for are written once, so a leader of very many pairs is no hot task."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    asked = texts.join(ends.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    if "texts" in scratch.paths:
        scratch.drop("texts")
    asked = scratch.put(asked, "texts")
    one = lambda x: asked.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "text_a", "text_b")


def difference_keys(x: np.ndarray, r: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """Size of the difference of sets ``x`` and ``r``, and the prefix of it, in
    the order of ``r``'s lists, that any partner of ``x`` outside ``r``'s links
    must meet.

    Sets of sizes n and m link if they differ in at most (den - num) / (den + num) *
    (n + m) tokens, and m is at most n * den / num; so a partner's difference has
    all but that many of ``x``'s.
    """
    more, less = np.setdiff1d(x, r, assume_unique=True), np.setdiff1d(r, x, assume_unique=True)
    often = _among(more, frequent)
    ordered = np.concatenate([more[~often], more[often], less])
    apart = (den - num) * len(x) // num  # (den - num) / (den + num) * (n + n * den / num)
    return len(ordered), ordered[: apart + 1]


def compared(pairs: DataFrame, texts: DataFrame, shared, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``a``, ``b``, ``n`` (size of ``a``'s set), ``linked``, ``d``, ``keys`` of each
    pair: whether ``a`` links with ``b``, and what :func:`difference_keys` gives."""

    def run(batches):
        sets, often = {}, shared.value
        for batch in slices(batches):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            n, linked, ds, keys = [], [], [], []
            for q, x, y in zip(b, ta, tb):
                if q not in sets:
                    if len(sets) >= 64:
                        sets.clear()
                    sets[q] = shingle_set(y, k)
                u, r = shingle_set(x, k), sets[q]
                d, some = difference_keys(u, r, often, num, den)
                n.append(len(u))
                linked.append((den + num) * d <= (den - num) * (len(u) + len(r)))
                ds.append(d)
                keys.append(some)
            cuts = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(ds, pa.int64()),
                pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
            ], ["a", "b", "n", "linked", "d", "keys"])

    return _with_texts(pairs, texts, scratch).mapInArrow(run, "a long, b long, n long, linked boolean, d long, keys array<long>")


def similar(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of
    lower-cased (A-Z) ``words``-grams, ``threshold = (num, den)``; fewer words
    are one shingle, and a text without words (or null) has the empty set, links
    with nothing and is its own component.  ``component_id`` is the smallest
    ``doc_id`` reachable by links.  Exact.  Rows that share an id are taken to
    be copies of one row; rows with a null id link with nothing and have a null
    component.  Other columns are ignored.  No rows in, none out.
    """
    num, den = threshold
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = np.sort(frequent_tokens(base, words).select("token").toArrow().column(0).to_numpy())  # at most FREQUENT_MOST
    often = base.sparkSession.sparkContext.broadcast(frequent)
    known = scratch.put(profiles(base, often, words, num, den), "profiles")
    sets = known.where("n > 0 and doc_id is not null")
    # What is joined to rows of a hot key is written first: the adaptive skew join
    # splits only what comes straight from a shuffle.
    rep = scratch.put(sets.groupBy("same").agg(F.min("doc_id").alias("rep")), "rep")
    firsts = sets.join(rep.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = scratch.put(firsts.select("doc_id", "n", "prefix", "singles", "whole"), "sets")

    # Entries of the lists that hold several documents.
    entry = F.posexplode(F.arrays_zip("keys", "places"))
    # Rare tokens are listed up to the last of the prefix, in order of the unsigned number.
    last = F.when(F.col("whole"), F.lit(2**63 - 1)).otherwise(F.element_at("prefix", F.col("singles")).bitwiseXOR(F.lit(-(2**63))))
    entries = firsts.select("doc_id", "n", "singles", last.alias("last"), entry.alias("at", "e")).select(
        "doc_id", "n", "singles", "last", F.col("e.keys").alias("token"), F.col("e.places").alias("place"), (F.col("at") < F.col("singles")).alias("rare"))
    entries = scratch.put(entries, "entries")
    several = scratch.put(entries.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "several")
    hits = scratch.put(entries.join(several.hint("merge"), "token"), "hits")
    scratch.drop("entries", "several")
    # By document: rare tokens of its prefix that no other prefix has, and how full its lists are.
    met = hits.groupBy("doc_id").agg(F.sum(F.col("rare").cast("int")).cast("int").alias("met"), (-F.sum("held")).alias("led"))
    alone = (F.col("singles") - F.col("met")).alias("alone")
    cut = F.floor(F.log("n") / (1.001 * math.log(den / num))) if num < den else F.col("n")
    cuts = F.explode(F.when(F.col("held") > SHORT, F.array(cut, cut + 1)).otherwise(F.array(F.lit(-1).cast("long")))).alias("cut")
    hits = hits.join(met.hint("merge"), "doc_id").select("token", "led", "doc_id", "n", "place", alone, "last", cuts).withColumn("token", F.xxhash64("token", "cut")).drop("cut")
    leads = F.min(F.struct("led", "doc_id", "n", "place", "alone", "last"))
    # Lists of the same documents are one list, with the least place of each.
    members = F.xxhash64(F.bit_xor(F.xxhash64("doc_id")), F.count("*"), F.min("doc_id"), F.max("doc_id"))
    sizes = scratch.put(hits.groupBy("token").agg(members.alias("list"), (F.count("*") > SHORT).alias("long"), leads.alias("f")), "sizes")
    least = lambda x: F.min(x).alias(x.split(".")[-1])
    lists = hits.drop("led").join(sizes.hint("merge"), "token").groupBy("list", F.col("f.doc_id").alias("first"), "doc_id").agg(
        *map(least, ("n", "place", "alone", "last", "long")), F.struct(*map(least, ("f.n", "f.place", "f.alone", "f.last"))).alias("f"))
    lists = scratch.put(lists, "lists")
    scratch.drop("hits", "sizes")

    # Sizes must allow the similarity, and so must what is left of each set.
    def fits(a: str, b: str) -> str:
        left = f"least({a}n - {a}place, {b}n - {b}place, if({a}last <= {b}last, {a}n - {a}alone, {a}n), if({b}last <= {a}last, {b}n - {b}alone, {b}n))"
        return f"{den} * least({a}n, {b}n) >= {num} * greatest({a}n, {b}n) and {num + den} * {left} >= {num} * ({a}n + {b}n)"

    ends = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    check = lambda pairs, name: verified(scratch.put(plausible(pairs, sets, num, den), name), base, words, num, den, scratch)
    pairs = lists.where("doc_id <> first").where(fits("", "f.")).select(*ends("doc_id", "first")).distinct()
    tried = scratch.put(pairs, "tried")
    links = scratch.put(check(tried, "plausible1"), "links1")
    part = scratch.put(connected_components(links, "a", "b").toDF("doc_id", "part"), "parts")

    # Lists whose documents are in several components by now.
    placed = lists.join(part.hint("merge"), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    mixed_up = scratch.put(placed.groupBy("list").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("list"), "mixed")
    opened = scratch.put(placed.join(mixed_up.hint("merge"), "list"), "open")
    scratch.drop("lists", "mixed")
    held = opened.where("not long").groupBy("list", "first").agg(F.collect_list(F.struct(*MEMBER)).alias("members"))
    short = within(held, num, den)

    versus = opened.where("long and doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    described = scratch.put(compared(versus, base, often, words, num, den, scratch), "described")
    met = described.where("linked").select(*ends("a", "b"))
    told = described.join(part.withColumnRenamed("doc_id", "a"), "a", "left").select(F.col("a").alias("doc_id"), F.coalesce("part", "a").alias("part"), "b", "n", "d", F.posexplode("keys").alias("place", "token"))
    several = told.groupBy("b", "token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("b", "token")
    differing = scratch.put(told.join(several.hint("merge"), ["b", "token"]), "differing")
    overlap = f"""{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
        and {2 * (den + num)} * least(a.d - a.place, b.d - b.place) >= {den + num} * (a.d + b.d) - {den - num} * (a.n + b.n)"""
    far = differing.alias("a").join(differing.alias("b").hint("merge"), ["b", "token"]).where("a.part < b.part").where(overlap).select(*ends("a.doc_id", "b.doc_id")).distinct()
    rest = short.union(far).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    more = scratch.put(check(rest, "plausible2"), "links2")
    links = scratch.put(links.union(met).union(more).distinct(), "links")
    scratch.drop("open", "described", "differing", "sets", "tried", "texts")

    parts = connected_components(links, "a", "b").toDF("rep", "component")
    return known.select("doc_id", "n", "same").join(rep.hint("merge"), "same", "left").join(parts.hint("merge"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"),
    )
