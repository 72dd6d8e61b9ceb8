"""An edge table kept up to date by a stream of changes.

Each batch of changes is a folder of its own that a rerun overwrites, so a batch
that was broken off and comes again changes nothing twice.  A reader merges the
newest base with the batches after it; every so many batches they become the
next base, so neither a batch nor a reader rewrites the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.streaming import into


class Adjacency:
    """Directed edges under ``path``; ``kind`` is the type of their ends."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", compact_every: int = 20) -> None:
        self.spark, self.path, self.kind, self.compact_every = spark, path, kind, compact_every
        for name, columns in (("base", "upto long"), ("changes", "op string, batch long")):
            # An empty folder of the right shape, where there is none yet.
            spark.createDataFrame([], f"src {kind}, dst {kind}, {columns}").drop("upto", "batch").coalesce(1).write.mode("ignore").parquet(f"{path}/{name}/{'upto' if name == 'base' else 'batch'}=-1")

    def _read(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromDDL(f"src {self.kind}, dst {self.kind}, {columns}")).parquet(f"{self.path}/{name}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take in ``op`` (``+`` or ``-``), ``src``, ``dst``, ``seq``: of several changes of an edge
        the last by ``seq`` holds, a removal among equals.  Removing an edge that isn't
        there and adding one that is are no errors; null ends are left out."""
        last = changes.where("src is not null and dst is not null and op in ('+', '-')").groupBy("src", "dst").agg(F.max(F.struct("seq", "op")).alias("last"))
        last.select("src", "dst", "last.op").write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        if (batch + 1) % self.compact_every == 0:
            self.edges(batch).write.mode("overwrite").parquet(f"{self.path}/base/upto={batch}")

    def edges(self, batch: int | None = None) -> DataFrame:
        """``src``, ``dst`` as they are, or as they were after ``batch``."""
        base, changes = self._read("base", "upto long"), self._read("changes", "op string, batch long")
        if batch is not None:
            base, changes = base.where(F.col("upto") < batch), changes.where(F.col("batch") <= batch)
        newest = base.agg(F.max("upto")).first()[0]  # of the folders' names
        newest = -1 if newest is None else newest
        rows = base.where(F.col("upto") == newest).select("src", "dst", F.lit("+").alias("op"), F.lit(newest).cast("long").alias("batch"))
        rows = rows.unionByName(changes.where(F.col("batch") > newest))
        return rows.groupBy("src", "dst").agg(F.max(F.struct("batch", "op")).alias("last")).where("last.op = '+'").select("src", "dst")

    def neighbors(self, batch: int | None = None) -> DataFrame:
        """``id``, ``degree``, ``least``: of nodes with an edge, either way, the number of
        different neighbours and the first of them."""
        e = self.edges(batch).where("src <> dst")
        both = e.union(e.select("dst", "src")).distinct()
        return both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.min("dst").alias("least"))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Apply each batch of a stream of changes; the query is returned, started."""
        return into(stream, self.apply, checkpoint)
