"""What a graph holds: its schema, its patterns, and figures of its properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from spindrift.graph import Graph
from spindrift.operators.iterate import dealt

#: Rows of a table that one task takes up.
ROWS_A_TASK = 200_000
_SCHEMA = "kind string, name string, property string, type string"


def schema(graph: Graph) -> DataFrame:
    """``kind`` (node or relationship), ``name``, ``property``, ``type``: from the tables'
    schemas alone, nothing is read.  A label or type without properties has one
    row whose property is null."""
    rows = []
    for kind, tables, ends in (("node", graph.labels, {"id"}), ("relationship", {t: r.table for t, r in graph.types.items()}, {"src", "dst"})):
        for name, table in tables.items():
            found = [(kind, name, f.name, f.dataType.simpleString()) for f in table.schema.fields if f.name not in ends]
            rows += found or [(kind, name, None, None)]
    return graph.spark.createDataFrame(rows, _SCHEMA)


def patterns(graph: Graph) -> DataFrame:
    """``source``, ``type``, ``target``, ``n``: relationships of each type by the labels at
    their ends (null where a type doesn't name one), one pass over each table."""
    parts = [r.table.agg(F.count("*").alias("n")).select(F.lit(r.source).cast("string").alias("source"), F.lit(t).alias("type"), F.lit(r.target).cast("string").alias("target"), "n") for t, r in graph.types.items()]
    return reduce(DataFrame.union, parts) if parts else graph.spark.createDataFrame([], "source string, type string, target string, n long")


def cardinalities(graph: Graph) -> DataFrame:
    """``type``, ``n``, ``sources``, ``targets``, ``most_out``, ``most_in``, ``kind`` of each type:
    the nodes at either end, the most relationships of one of them, and whether it
    is ``1:1``, ``1:n``, ``n:1`` or ``n:m``.

    Both ends are counted by key map-side; a relationship with a null end isn't
    counted there.
    """
    parts = []
    for name, r in graph.types.items():
        ends = r.table.select(F.explode(F.array(F.struct(F.lit(True).alias("out"), F.col("src").cast("string").alias("id")), F.struct(F.lit(False).alias("out"), F.col("dst").cast("string").alias("id")))).alias("e"))
        each = ends.where("e.id is not null").groupBy("e.out", "e.id").agg(F.count("*").alias("n"))
        side = lambda f, out: F.coalesce(f(F.when(F.col("out") == out, F.col("n"))), F.lit(0))
        found = each.agg(side(F.sum, True).alias("n"), F.count_if("out").alias("sources"), F.count_if(~F.col("out")).alias("targets"), side(F.max, True).alias("most_out"), side(F.max, False).alias("most_in"))
        kind = F.concat(F.when(F.col("most_in") > 1, "n").otherwise("1"), F.lit(":"), F.when((F.col("most_out") > 1) & (F.col("most_in") > 1), "m").when(F.col("most_out") > 1, "n").otherwise("1"))
        parts.append(found.select(F.lit(name).alias("type"), "*", kind.alias("kind")))
    return reduce(DataFrame.union, parts)


def analyze(table: DataFrame, exact: bool = False) -> DataFrame:
    """``property``, ``type``, ``n``, ``nulls``, ``different``, ``least``, ``greatest`` of each column.

    One aggregation over one scan: ``different`` is an estimate unless ``exact``, which
    shuffles every column's values.  Extremes are strings, and null for nested
    columns, whose different values count by their JSON.  Rows are dealt by a hash of
    their plain columns first, so a task holds the values of a bounded number.
    """
    plain = [f"`{f.name}`" for f in table.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    table = table.repartition(dealt(table, ROWS_A_TASK), *plain)
    aggregates, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(table.schema.fields):
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        value = F.to_json(F.struct(c.alias("v"))) if nested else c
        value = F.when(c.isNotNull(), value)
        aggregates += [F.count(c).alias(f"n{i}"), (F.count_distinct(value) if exact else F.approx_count_distinct(value)).alias(f"d{i}")]
        aggregates += [(F.lit(None).cast("string") if nested else g(c).cast("string")).alias(f"{name}{i}") for name, g in (("l", F.min), ("g", F.max))]
        entries.append(F.struct(F.lit(f.name).alias("property"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("n"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("different"), F.col(f"l{i}").alias("least"), F.col(f"g{i}").alias("greatest")))
    return table.agg(*aggregates).select(F.explode(F.array(*entries)).alias("p")).select("p.*")


def types_of(table: DataFrame, properties: str = "properties") -> DataFrame:
    """``property``, ``type``, ``n`` of the values of a map of strings, by what they look like:
    ``integer``, ``float``, ``boolean``, ``date``, ``string`` or ``null``."""
    kv = table.select(F.explode(properties).alias("property", "v"))
    v = F.col("v")
    kind = (
        F.when(v.isNull(), "null").when(v.rlike(r"^[+-]?\d{1,18}$"), "integer").when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .when(F.lower(v).isin("true", "false"), "boolean").when(F.try_to_date(F.when(v.rlike(r"^\d{4}-\d\d-\d\d$"), v)).isNotNull(), "date").otherwise("string")
    )
    return kv.groupBy("property", kind.alias("type")).agg(F.count("*").alias("n"))


def compare(one: Graph, other: Graph) -> DataFrame:
    """``kind``, ``name``, ``property``, ``one``, ``other``: where two schemas differ, with the
    property's type in each (null: it isn't there).  Nothing is read."""
    keys = ["kind", "name", "property"]
    side = lambda g, out: schema(g).select(*keys, F.coalesce("type", F.lit("-")).alias(out))
    a, b = side(one, "one"), side(other, "other")
    same = reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
    both = a.join(b, same, "full").where("not one <=> other")
    return both.select(*(F.coalesce(a[k], b[k]).alias(k) for k in keys), F.nullif("one", F.lit("-")).alias("one"), F.nullif("other", F.lit("-")).alias("other"))


def orphans(graph: Graph) -> DataFrame:
    """``type``, ``end``, ``id``, ``n``: ends of relationships whose node isn't there, with
    the number of relationships; null ends too.  Types that don't name a label at
    an end aren't looked at there.  Both sides are dealt by id into as many tasks as
    the nodes need."""
    parts = []
    for name, r in graph.types.items():
        for end, label in (("src", r.source), ("dst", r.target)):
            if label in graph.labels:
                tasks = dealt(graph.labels[label], ROWS_A_TASK)
                ends = r.table.select(F.col(end).alias("id")).repartition(tasks, "id").groupBy("id").agg(F.count("*").alias("n"))
                missing = ends.join(graph.labels[label].select("id").repartition(tasks, "id"), "id", "left_anti")
                parts.append(missing.select(F.lit(name).alias("type"), F.lit(end).alias("end"), F.col("id").cast("string").alias("id"), "n"))
    return reduce(DataFrame.union, parts) if parts else graph.spark.createDataFrame([], "type string, end string, id string, n long")
