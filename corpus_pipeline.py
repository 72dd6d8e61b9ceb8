"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents for the next;
the last returns packed pieces.  Every stage works on all rows it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import op3_lines, op4_quality, op5_mixing, op8_jaccard, op9_packing
from spindrift.llm.common import documents, written
from spindrift.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.  It learns from the labelled
    rows among ``docs`` outside the held-out fold."""
    model = op4_quality.fit(op4_quality.training_rows(docs, documents(spark, sf_dir, "labels")))
    return op4_quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; all documents stay."""
    out = op3_lines.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of five-word shingle similarity 0.8, and
    all without an id."""
    groups = op8_jaccard.similar(docs, words=5, threshold=(80, 100))
    later = groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some twice, some not at all."""
    return op5_mixing.mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return op9_packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
    ("source mixing", mixing), ("best-fit packing", packing),
]

#: The classifier and the tokenizer are beyond SQL; tests hold each stage against
#: a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
