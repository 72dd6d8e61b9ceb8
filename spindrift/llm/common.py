"""Small helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Removes the shuffle files of a query when its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without: a folder of its own machine would be
    another one on each machine of a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
    return found


class Scratch:
    """Tables that an operator writes between its steps to the shared folder.

    A written table cuts the lineage with files that outlive any executor, so a
    lost one costs only the tasks it was running.  A step's shuffle files go as
    soon as its table is written, and :meth:`drop` empties tables that no later
    step reads, so the disk holds a few steps and not all of them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths = spark, checkpoint_dir(spark), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back."""
        path = self.paths[name] = f"{self.root}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(self.paths.pop(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return Scratch(df.sparkSession).put(df, name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows``: what a worker makes of texts at once is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cells(rows: int, per_cell: int, most: int = 1 << 16) -> int:
    """How many cells keep about ``per_cell`` rows in each; never over ``most``."""
    return max(1, min(most, -(-rows // per_cell)))


def running_offsets(
    totals: DataFrame, keys: Sequence[str], cell: str, size: str, out: str
) -> DataFrame:
    """Exclusive prefix sum of ``size`` over ``cell`` for each ``keys``.

    ``totals`` has one row for each key and cell, so the window is small however
    many rows were counted.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def null_safe(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
