"""Operators 11 to 13 against plain versions, and on rows out of the ordinary."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import op11_trie, op12_bpe, op13_runs, registry
from spindrift.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, depth long, cell int, n long, i long"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rebuilt(turns, heads):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, op11_key(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    if not heads:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def op11_key(role, text):
    """Equal turns are ordered by the digest, as signed halves."""
    d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 8], "big", signed=True) for i in (0, 8))


def _trie(convs):
    """conv_id, depth, parent, members, children, leaves, saved, digest of each node."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = set()

    def total(p):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for q in children[p]:
            a, b = total(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *total(p), _sha(ends)))
    return out


def _nodes(df):
    return {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()}


def _conversations(rnd, n):
    turns = []
    for c in rnd.sample(range(1000), n):
        for t in range(rnd.randrange(1, 9)):
            turns.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "é", "", None, "longer text"])))
    return turns


@pytest.mark.parametrize("heads", [False, True])
def test_trie(spark, heads, monkeypatch):
    monkeypatch.setattr(op11_trie, "BLOCK", 3)
    rnd = random.Random(8)
    turns = [*_conversations(rnd, 120), (None, 0, "user", "no conversation"), (7000, None, "user", "null first"), (7000, 0, "user", "a"), (7000, 0, "user", "a"), (-205, 1, "user", "below"), (-205, 0, None, None)]
    turns += [(9000, t, "user", "same") for t in range(40)] + [(9001, t, "user", "same") for t in range(37)]
    rnd.shuffle(turns)
    df = spark.createDataFrame([(*t, 1, 2, 3, 4) for t in turns], TURNS)
    got = op11_trie.conversation_trie(df, shared_heads=heads, rows_per_cell=50)
    convs = _rebuilt(turns, False)
    if heads:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        base = {c: c - (c % 100 if c >= 0 else -(-c % 100)) for c in convs}  # the sign of a remainder is its dividend's
        convs = {c: convs.get(base[c], [])[: h[c]] + convs[c][h[c] :] for c in convs}
    want = _trie(convs)
    rows = _nodes(got)
    assert rows == want and got.count() == len(want)


def test_trie_turnless_and_empty(spark):
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    found = op11_trie.conversation_trie(spark.createDataFrame([(alone, 0, "user", "gone")], "conv_id long, turn long, role string, text string"), shared_heads=True)
    assert _nodes(found) == {(alone, 0, None, 1, 0, 1, 0, _sha(str(alone)))}
    assert op11_trie.conversation_trie(spark.createDataFrame([], TURNS), shared_heads=True).count() == 0


def test_rollup_takes_logarithmic_rounds(spark):
    """A chain of 100 nodes under two leaves: 7 rounds, every ancestor has both."""
    chain = [(d, d, 0, d - 1 if d else None, 0 if d else None, 0) for d in range(101)]
    rows = [*chain, (101, 500, 0, 100, 0, 1), (101, 501, 0, 100, 0, 1)]
    nodes = spark.createDataFrame(rows, "depth long, k1 long, k2 long, p1 long, p2 long, leaf long")
    scratch = Scratch(spark)
    found = {r["depth"]: r["leaf"] for r in op11_trie.rolled_up(nodes, ["leaf"], scratch).collect()}
    assert found == {**{d: 2 for d in range(101)}, 101: 1}
    assert len([p for p in scratch.paths if p.startswith("gain")]) == 7


def test_long_conversation_is_cut(spark):
    turns = spark.range(5000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "'x' as text")
    found = op11_trie.ordered(turns, Scratch(spark), rows_per_cell=700)
    assert [r["i"] for r in found.orderBy("i").collect()] == list(range(5000))
    assert op11_trie.conversation_trie(turns).agg(F.sum("saved_tokens"), F.count("*"), F.max("depth")).first()[:3] == (0, 5001, 5000)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def test_encoding_equals_the_library(tokenizer):
    rnd = random.Random(5)
    coder = op12_bpe.Coder(registry.tokenizer_path(), words_kept=50)
    signs = [*"abcDEF 'st\n\t!?<|>12éÅΣΑσ中国😀ﬁİǅ", "é", "H̱", "\x1c", "\x1f", "\x85", " ", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'S", "the", "ing", "x" * 90]
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(30)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_merges_skip_stale_entries():
    """Merging the middle pair first makes both outer pairs stale."""
    pair = lambda a, b: (a << op12_bpe.ID_BITS) | b
    ranks = {pair(2, 3): 0, pair(1, 2): 1, pair(3, 4): 2, pair(1, 9): 3}
    assert op12_bpe.merged([1, 2, 3, 4], ranks, [9, 8, 7, 6]) == [6, 4]
    assert op12_bpe.merged([5, 5, 5], {pair(5, 5): 0}, [6]) == [6, 5]  # the leftmost of equals
    assert op12_bpe.merged([], {}, []) == [] and op12_bpe.merged([3], {}, []) == [3]


ODD = [None, "", " \n\t", "one", "é  x y", "Word, word!" * 2000, "a\n\nb\n", "same text here", "same text here", "a b " * 4000]


def _odd(spark):
    rows = [(None if i == 4 else min(i, 8), t, "s", 1, 2, 3, 4, "k", "r", "c") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_runs int, start int, length int, period int, ids string, runs string, decoded string")


def test_encoded_odd_rows(spark, tokenizer):
    got = sorted((repr(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in op12_bpe.encode_documents(_odd(spark), registry.tokenizer_path()).collect())
    want = []
    for i, t in enumerate(ODD):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((repr(None if i == 4 else min(i, 8)), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert op12_bpe.encode_documents(_odd(spark).where("false"), registry.tokenizer_path()).count() == 0


def test_other_tokenizer_files_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        op12_bpe.Vocabulary(str(public_tokenizers.path("byte_bpe_50k.json")))


def _runs(w, least_length=6, least_power=4):
    n, out = len(w), set()
    for q in range(1, n // least_power + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(least_length, least_power * q) and not any(all(w[s + j] == w[s + j + d] for j in range(size - d)) for d in range(1, q)):
                out.add((s, size, q))
            i += i == s
    return sorted(out)


def test_runs():
    rnd = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(rnd.randrange(1, 6)):
            k, m = rnd.choice([1, 2, 2, 3, 50]), rnd.randrange(60)
            w = [b"%d" % rnd.randrange(k) for _ in range(m)]
            if rnd.random() < 0.7:
                unit, at = [b"%d" % rnd.randrange(k) for _ in range(rnd.randrange(1, 9))], rnd.randrange(m + 1)
                w = w[:at] + (unit * rnd.randrange(2, 9))[: rnd.randrange(1, 60)] + w[at:]
            docs.append(w)
        for least in ((6, 4), (2, 2), (5, 3)):
            for w, found in zip(docs, op13_runs._found(docs, *least)):
                assert sorted(map(tuple, found.tolist())) == _runs(w, *least)


def test_next_smaller():
    rnd = random.Random(2)
    for n in (1, 2, 17, 18, 19, 40, 300):
        values = np.array(rnd.sample(range(n), n))
        for v in (values, np.sort(values)[::-1], np.sort(values)):
            assert op13_runs.next_smaller(v).tolist() == [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]


def _plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = sorted((s, q, m) for s, m, q in _runs(w))
    gone = {i for s, q, m in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (repr(doc_id), len(found), *map(repr, top), "".join(f"{s},{m},{q}\n" for s, q, m in found), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_run_rows(spark):
    rnd = random.Random(6)
    texts = {i: " ".join(f"w{rnd.randrange(4)}" for _ in range(rnd.randrange(80))) for i in range(200)}
    docs = spark.createDataFrame([*texts.items(), (None, "x " * 9), (3, None)], "doc_id long, text string").unionByName(_odd(spark).where("length(text) < 1000 or text is null").select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")
    got = sorted((repr(r["doc_id"]), r["n_runs"], *(repr(r[c]) for c in names[1:5]), r["runs"], r["collapsed"]) for r in op13_runs.find_runs(docs, op13_runs.repeated_tail, at_once=100).collect())
    assert got == sorted(_plain_row(*r) for r in rows)
    long = {r["text_size"]: r for r in op13_runs.find_runs(_odd(spark)).withColumn("text_size", F.length("collapsed")).collect()}
    assert any(r["length"] == 8000 and r["period"] == 2 and r["collapsed"] == "a b" for r in long.values())
    assert op13_runs.find_runs(_odd(spark).where("false")).count() == 0
