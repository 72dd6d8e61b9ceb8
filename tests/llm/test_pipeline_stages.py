"""Each stage of the pipeline against a plain version, on small and odd documents."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import op4_quality, registry
from tests.duck import SF, connection

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, predicted int, piece int, component_id long, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def _rows(df):
    return sorted(map(repr, (tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect())))


def test_quality_keeps_what_the_classifier_accepts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = op4_quality.fit(op4_quality.training_rows(docs, labels))
    good = {r["doc_id"] for r in op4_quality.score(docs, model).where("score >= 0.3").collect()}
    assert _rows(corpus_pipeline.quality(spark, docs, SF)) == _rows(docs.where(F.col("doc_id").isin(*good)))
    # Labelled rows of the held-out fold, which the fit didn't see.
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("doc_id", "quality").collect()
    assert sum((r["doc_id"] in good) == (r["quality"] == 1) for r in held) >= 0.8 * len(held)


def test_lines_by_a_plain_loop(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    key = lambda line: line.strip(STRIP).translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = {i: "\n".join(x for x in (t or "").split("\n") if common.get(key(x), i) == i) for i, t in texts.items()}
    out = corpus_pipeline.lines(spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want and all(r["n_chars"] == len(r["text"]) for r in out)
    assert any(want[i] != (t or "") for i, t in texts.items())


def test_near_duplicates_by_all_pairs(spark, docs):
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    want = {i for i in ids if root(i) == i}
    assert _rows(corpus_pipeline.near_duplicates(spark, docs, SF)) == _rows(docs.where(F.col("doc_id").isin(*want)))
    assert len(want) < len(ids)


def test_mixing_takes_what_the_sql_says(spark, docs):
    con = connection()
    taken = {i: n for i, n in con.execute(f"SELECT doc_id, sum(taken) FROM ({registry.ORACLE_SQL['op5_source_mixing']}) GROUP BY doc_id").fetchall()}
    got = defaultdict(int)
    for r in corpus_pipeline.mixing(spark, docs, SF).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}


def test_packing_fills_sequences_without_gaps(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.packing(spark, docs, SF).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        found, total = sorted(pieces[r["doc_id"]]), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert [(i, 2048 * i, min(2048, total - 2048 * i)) for i in range(-(-total // 2048))] == found
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(n for p in places.values() for _, n in p) // 2048) * 1.05 + 1


ODD = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "one two three four five six", "en", "s", 27), (4, "one two three four five six", "en", "s", 27), (None, "no id", "en", "s", 5), (3, "one two three four five six", "en", "s", 27)]


def test_stages_on_odd_rows(spark):
    """Null ids, texts and sources, empty texts, repeated rows and clashing columns: all
    rows pass but copies, at the Jaccard stage, and rejected ones, at the first."""
    rows = spark.createDataFrame([(*r, 0, 1, 2, 3) for r in ODD], SCHEMA)
    kept = corpus_pipeline.quality(spark, rows, SF)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS and kept.count() <= len(ODD)
    assert corpus_pipeline.lines(spark, rows, SF).count() == len(ODD)
    near = corpus_pipeline.near_duplicates(spark, rows, SF)
    assert sorted(repr(r["doc_id"]) for r in near.collect()) in (["1", "2", "3", "3", "None"], ["1", "2", "3", "None"])
    assert {r["doc_id"] for r in corpus_pipeline.mixing(spark, rows, SF).where("text <> ''").collect()} <= {3, 4, None}
    assert corpus_pipeline.packing(spark, rows, SF).count() == len(ODD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_without_rows(spark, name):
    none = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, none, SF).count() == 0
