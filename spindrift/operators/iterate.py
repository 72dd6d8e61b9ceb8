"""Loops over DataFrames, with their lineage cut in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; only
    a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/checkpoints"


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once and read back: an executor that is lost takes nothing
    with it, and plans of later rounds stay small."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> int:
    """Partitions for a shuffle of ``df`` with some ``rows`` each, and no fewer than
    the session has: a fixed number would let a task grow with its input.  The
    count of a table comes from its files' footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


@contextmanager
def bucketed_tables(spark: SparkSession, key: str, buckets: int) -> Iterator[Callable[..., DataFrame]]:
    """``keep(df)``: ``df`` written as a table in buckets by ``key``, and read back.  Joins and
    groups whose keys hold that one move no rows of such tables, and shuffles have as
    many partitions.  With a second argument, tables of that name are one, with a folder for
    each value of ``round``.  The tables are dropped at the end: what is left must be settled."""
    names, confs = {}, {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {c: spark.conf.get(c) for c in confs}

    def keep(df: DataFrame, together: str | None = None) -> DataFrame:
        name = names.setdefault(together or len(names), f"kept_{uuid.uuid4().hex}")
        out = df.write.mode("append").option("compression", "zstd").bucketBy(buckets, key)
        (out.partitionBy("round") if together else out).saveAsTable(name)
        return spark.table(name)

    for c, value in confs.items():
        spark.conf.set(c, value)
    try:
        yield keep
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
