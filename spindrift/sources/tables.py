"""Tables: CSV, JSON, XML, Parquet, text chunks and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Line ends outside quoted fields.
_LINE_END = r'\r?\n(?=(?:[^"]*"[^"]*")*[^"]*$)'


def load_csv(spark: SparkSession, path: str, header: bool = True, separator: str = ",") -> DataFrame:
    """``line_no``, ``list``, ``map`` of each line of a file or of each file of a
    folder, all values strings.

    ``line_no`` counts from 1 within a file and counts the header, which each
    file has of its own; a quoted field may hold line ends.  So a file is
    read whole by one task; for large files use :func:`read_csv`.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n$", ""), _LINE_END).alias("lines"))
    parsed = lambda line: F.transform(
        F.split(line, f'{re.escape(separator)}(?=(?:[^"]*"[^"]*")*[^"]*$)'),
        lambda x: F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"')))
    rows = whole.select(parsed(F.get("lines", F.lit(0))).alias("names"), F.posexplode("lines").alias("i", "line")).select((F.col("i") + 1).alias("line_no"), "names", parsed(F.col("line")).alias("list"))
    if not header:
        return rows.select("line_no", "list", F.create_map().cast("map<string,string>").alias("map"))
    return rows.where("line_no > 1").select("line_no", "list", F.map_from_arrays("names", "list").alias("map"))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, separator: str = ",") -> DataFrame:
    """Typed, split among tasks, with columns that aren't used left unparsed."""
    return spark.read.schema(schema).csv(path, header=header, sep=separator)


def load_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def load_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each item of a file's array."""
    return load_json(spark, path, schema, multi_line=True)


def load_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet, JSON, CSV (with header) or ORC."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    getattr(writer, kind)(path)


def layout(df: DataFrame, path: str, keys: list[str], partitions: int) -> None:
    """Parquet sorted by ``keys`` within ranges of them: what a range or
    composite index is for, as row groups outside a predicate are skipped."""
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.parquet(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``bytes``, ``modified``, ``sha256``, ``text`` of files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of (start, text): pieces of at most ``size`` characters that overlap."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("start"), F.substr(text, i * step + 1, F.lit(size)).alias("text")))
