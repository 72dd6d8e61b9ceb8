"""Queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from spindrift.llm.registry import ORACLE_SQL, QUERIES
from tests.duck import SF, connection, of_spark, of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_sql(connection(), ORACLE_SQL[name])


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        n = out.count()
        assert n == before if name == "line dedup" else 0 < n
        if name in ("quality classifier", "n-gram Jaccard join"):
            assert n < before
        docs, before = out, n
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
