"""Nested documents as typed node and relationship tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from spindrift.graph import Graph, Relationships


def _children(schema: StructType) -> list[tuple[str, StructType, bool]]:
    """Fields that hold documents: name, their schema, whether there are many."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, StructType):
            out.append((f.name, f.dataType, False))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            out.append((f.name, f.dataType.elementType, True))
    return out


def _named(label: str, field: str) -> str:
    return f"{label}_{field}"


def _field(doc: str | Column, name: str) -> Column:
    return (F.col(doc) if isinstance(doc, str) else doc).getField(name)


def from_documents(docs: DataFrame, label: str = "Document", key: str | None = None) -> Graph:
    """A graph of documents: a node for each, and one for every document inside.

    A node table has ``id`` and ``properties``, a struct of the fields that hold no
    documents; of an array of documents it keeps the length.  The nodes of a field
    are labelled by the path to it and related by the same name in capitals, with
    ``index`` where there are many.  An id is the label with ``key``, or without one
    a digest of the document, and then the path, so the same documents have the
    same ids in every run.  Of documents that share a key the greatest as JSON is
    taken; those whose key is null are left out.  Tables stay lazy over ``docs``.
    """
    schema = docs.schema
    doc = F.struct(*(F.col(f"`{f.name}`") for f in schema.fields))
    name = F.col(f"`{key}`").cast("string") if key else F.sha2(F.to_json(doc, {"ignoreNullFields": "false"}), 256)
    roots = docs.select(F.concat(F.lit(f"{label}/"), name).alias("id"), doc.alias("doc")).where("id is not null")
    roots = roots.groupBy("id").agg(F.max_by("doc", F.to_json("doc", {"ignoreNullFields": "false"})).alias("doc"))
    labels: dict[str, DataFrame] = {}
    types: dict[str, Relationships] = {}

    def walk(table: DataFrame, schema: StructType, label: str) -> None:
        inner = {n: many for n, _, many in _children(schema)}
        kept = [_field("doc", f.name).alias(f.name) for f in schema.fields if f.name not in inner]
        kept += [F.when(_field("doc", n).isNotNull(), F.size(_field("doc", n))).alias(n) for n, many in inner.items() if many]
        labels[label] = table.select("id", (F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("_"))).alias("properties"))
        for n, sub, many in _children(schema):
            if many:
                part = table.select(F.col("id").alias("src"), F.posexplode(_field("doc", n)).alias("index", "doc"))
                part = part.withColumn("id", F.concat("src", F.lit(f"/{n}/"), F.col("index").cast("string")))
            else:
                part = table.select(F.col("id").alias("src"), F.lit(None).cast("int").alias("index"), _field("doc", n).alias("doc")).withColumn("id", F.concat("src", F.lit(f"/{n}")))
            part = part.where("doc is not null")
            types[_named(label, n).upper()] = Relationships(part.select("src", F.col("id").alias("dst"), "index"), label, _named(label, n))
            walk(part.select("id", "doc"), sub, _named(label, n))

    walk(roots, schema, label)
    return Graph(docs.sparkSession, labels, types)


def _in_order(by_index: str, size: Column) -> Column:
    """The values of a map at 0 to ``size`` - 1, null where there is none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda k: F.try_element_at(F.col(by_index), k))


def to_documents(graph: Graph, schema: StructType, label: str = "Document") -> DataFrame:
    """The documents of :func:`from_documents`, with the columns of ``schema``.

    Built from the inside out: each level is grouped by the node it belongs to, so
    a document is as large as a row can be.
    """

    def build(schema: StructType, label: str) -> DataFrame:
        """``id``, ``doc`` of a label's nodes."""
        out = graph.labels[label].select("id", "properties")
        made = {}
        for i, (n, sub, many) in enumerate(_children(schema)):
            rel = graph.types[_named(label, n).upper()].table
            inner = rel.join(build(sub, _named(label, n)).withColumnRenamed("id", "dst"), "dst")
            if many:
                inner = inner.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("index", "doc"))).alias(f"c{i}"))
            else:
                inner = inner.select("src", F.col("doc").alias(f"c{i}"))
            out = out.join(inner.withColumnRenamed("src", "id"), "id", "left")
            if many:
                size, empty = _field("properties", n), F.array().cast(ArrayType(sub))
                made[n] = F.when(size == 0, empty).when(size > 0, _in_order(f"c{i}", size))
            else:
                made[n] = F.col(f"c{i}")
        fields = [made.get(f.name, _field("properties", f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
        return out.select("id", F.struct(*fields).alias("doc"))

    return build(schema, label).select("doc.*")
