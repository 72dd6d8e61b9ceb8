"""What a small graph holds."""

from spindrift.graph import Graph, Relationships
from spindrift.operators import inspection


def _graph(spark, more=False):
    person = spark.createDataFrame([(1, "a", [1]), (2, None, []), (3, "a", None)], "id long, name string, tags array<int>")
    city = spark.createDataFrame([("x",)], "id string")
    lives = spark.createDataFrame([(1, "x", 3), (2, "y", 4), (None, "x", 5), (1, "y", None)], "src long, dst string, since int")
    labels = {"Person": person.withColumnRenamed("name", "called") if more else person, "City": city}
    return Graph(spark, labels, {"LIVES_IN": Relationships(lives, "Person", "City"), "KNOWS": Relationships(lives.select("src", lives.src.alias("dst")), "Person", None)})


def test_schema_and_compare(spark):
    rows = {tuple(r) for r in inspection.schema(_graph(spark)).collect()}
    assert rows == {("node", "Person", "name", "string"), ("node", "Person", "tags", "array<int>"), ("node", "City", None, None), ("relationship", "LIVES_IN", "since", "int"), ("relationship", "KNOWS", None, None)}
    assert inspection.compare(_graph(spark), _graph(spark)).count() == 0
    assert {tuple(r) for r in inspection.compare(_graph(spark), _graph(spark, more=True)).collect()} == {("node", "Person", "name", "string", None), ("node", "Person", "called", None, "string")}


def test_figures(spark):
    g = _graph(spark)
    assert {tuple(r) for r in inspection.analyze(g.nodes("Person"), exact=True).collect()} == {
        ("id", "bigint", 3, 0, 3, "1", "3"), ("name", "string", 2, 1, 1, "a", "a"), ("tags", "array<int>", 2, 1, 2, None, None)}
    assert [r["n"] for r in inspection.analyze(g.nodes("Person").where("false")).collect()] == [0, 0, 0]
    assert {tuple(r) for r in inspection.patterns(g).collect()} == {("Person", "LIVES_IN", "City", 4), ("Person", "KNOWS", None, 4)}
    found = {r["type"]: tuple(r)[1:] for r in inspection.cardinalities(g).collect()}
    assert found == {"LIVES_IN": (3, 2, 2, 2, 2, "n:m"), "KNOWS": (3, 2, 2, 2, 2, "n:m")}


def test_orphans(spark):
    assert {tuple(r) for r in inspection.orphans(_graph(spark)).collect()} == {("LIVES_IN", "src", None, 1), ("LIVES_IN", "dst", "y", 2), ("KNOWS", "src", None, 1)}


def test_types_of_strings(spark):
    rows = [({"a": "1", "b": "2.5", "c": "TRUE", "d": "2020-02-30", "e": None},), ({"a": "-7", "b": "1e9", "c": "no", "d": "2020-02-29"},), (None,)]
    got = {tuple(r) for r in inspection.types_of(spark.createDataFrame(rows, "properties map<string,string>")).collect()}
    assert got == {("a", "integer", 2), ("b", "float", 2), ("c", "boolean", 1), ("c", "string", 1), ("d", "string", 1), ("d", "date", 1), ("e", "null", 1)}
