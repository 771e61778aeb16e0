import pytest
from pyspark.sql import functions as F, types as T

from tablechange.operators.nested import diff_nested_schemas, evolve_nested, shape

OLD = """id int, head struct<status:string,total:double,`odd name`:int>, items array<struct<line:int,price:double,tags:map<string,struct<weight:int,gone:string>>>>,
  grid array<array<struct<x:int>>>, plain array<int>"""
NEW = """id int, header struct<status_code:string,total:decimal(10,2),`odd name`:bigint,added:struct<a:int>>,
  items array<struct<line:bigint,price:double,tags:map<string,struct<weights:int>>,note:string>>, grid array<array<struct<x:string>>>, plain array<bigint>"""


def schema(spark, text):
    return spark.createDataFrame([], text).schema


@pytest.fixture()
def data(spark):
    rows = [
        (1, ("A", 1.5, 3), [(1, 2.5, {"k": (7, "g"), "n": None}), (2, None, None)], [[(1,), None], None], [1, 2]),
        (2, None, None, None, None),
        (3, (None, None, None), [], [[]], []),
        (4, ("B", 2.25, None), [None], [[(5,)]], [None]),
    ]
    return spark.createDataFrame(rows, OLD)


def test_changes_at_all_levels(spark):
    found = diff_nested_schemas(spark, {"t": schema(spark, OLD), "gone": schema(spark, "a int")}, {"t": schema(spark, NEW), "other": schema(spark, "b string")})
    assert {(r["kind"], r["scope"], r["key"], r["old_key"], r["destructive"]) for r in found.collect()} == {
        ("drop", "gone", "gone", None, True), ("create", "other", "other", None, False),
        ("rename_column", "t", "header", "head", False),
        ("rename_column", "t:header", "status_code", "status", False), ("retype_column", "t:header", "total", None, True),
        ("retype_column", "t:header", "odd name", None, False), ("add_column", "t:header", "added", None, False),
        ("retype_column", "t:items[]", "line", None, False), ("add_column", "t:items[]", "note", None, False),
        ("rename_column", "t:items[].tags{}", "weights", "weight", False), ("drop_column", "t:items[].tags{}", "gone", None, True),
        ("retype_column", "t:grid[][]", "x", None, False), ("retype_column", "t", "plain", None, True),
    }


def test_evolve_at_all_levels(spark, data):
    target = schema(spark, NEW)
    changes = diff_nested_schemas(spark, {"t": data.schema}, {"t": target})
    got = evolve_nested(data, changes, "t", target, force_drop=True)
    assert got.schema.simpleString() == target.simpleString()
    rows = {r["id"]: r.asDict(True) for r in got.collect()}
    from decimal import Decimal

    assert rows[1] == {
        "id": 1, "header": {"status_code": "A", "total": Decimal("1.50"), "odd name": 3, "added": None},
        "items": [{"line": 1, "price": 2.5, "tags": {"k": {"weights": 7}, "n": None}, "note": None}, {"line": 2, "price": None, "tags": None, "note": None}],
        "grid": [[{"x": "1"}, None], None], "plain": [1, 2],
    }
    assert rows[2] == {"id": 2, "header": None, "items": None, "grid": None, "plain": None}
    assert rows[4]["items"] == [None] and rows[3]["header"] == {"status_code": None, "total": None, "odd name": None, "added": None}


def test_drops_and_losses_wait(spark, data):
    changes = diff_nested_schemas(spark, {"t": data.schema}, {"t": schema(spark, NEW)})
    safe = evolve_nested(data, changes, "t", schema(spark, NEW))
    assert "tags{}" not in safe.columns and [f.name for f in safe.schema["items"].dataType.elementType["tags"].dataType.valueType.fields] == ["weights", "gone"]
    assert safe.schema["header"].dataType["total"].dataType == T.DecimalType(10, 2)  # no value is lost
    lossy = data.withColumn("head", F.col("head").withField("total", F.lit(1.005)))
    assert evolve_nested(lossy, changes, "t", schema(spark, NEW)).schema["header"].dataType["total"].dataType == T.DoubleType()
    narrow = diff_nested_schemas(spark, {"t": schema(spark, "a array<struct<n:bigint>>")}, {"t": schema(spark, "a array<struct<n:int>>")})
    for value, kept in ((5, "int"), (1 << 40, "bigint")):
        frame = spark.createDataFrame([([(value,), None],), (None,)], "a array<struct<n:bigint>>")
        assert evolve_nested(frame, narrow, "t").schema["a"].dataType.elementType["n"].dataType.simpleString() == kept
    with pytest.raises(Exception, match="cannot cast"):
        evolve_nested(frame, narrow, "t", force_drop=True).collect()
    assert evolve_nested(frame, narrow, "t", force_drop=True, on_error="null").first()["a"][0]["n"] is None


def test_other_shapes_and_no_change(spark, data):
    assert shape(data.schema["items"].dataType) == "array<struct>" and shape(data.schema["plain"].dataType) == "array<int>"
    same = diff_nested_schemas(spark, {"t": data.schema}, {"t": data.schema})
    assert same.count() == 0 and evolve_nested(data, same, "t").collect() == data.collect()
    into = diff_nested_schemas(spark, {"t": schema(spark, "a struct<x:int>")}, {"t": schema(spark, "a array<struct<x:int>>")})
    assert [(r["kind"], r["key"], r["destructive"]) for r in into.collect()] == [("retype_column", "a", True)]
    frame = spark.createDataFrame([((1,),)], "a struct<x:int>")
    assert evolve_nested(frame, into, "t").schema == frame.schema  # the value has no place in the new shape
    assert diff_nested_schemas(spark, {}, {}).count() == 0
    keys = diff_nested_schemas(spark, {"t": schema(spark, "m map<struct<a:int>,int>")}, {"t": schema(spark, "m map<struct<a:string>,int>")})
    frame = spark.createDataFrame([({(1,): 2},)], "m map<struct<a:int>,int>")
    assert evolve_nested(frame, keys, "t").select(F.map_keys("m")[0]["a"]).first()[0] == "1"
