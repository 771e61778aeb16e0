import re

import pytest
from pyspark.sql import functions as F

from tablechange.operators.schemas import (
    add_column,
    diff_schemas,
    drop_column,
    evolve,
    keeps_values,
    lost_values,
    rename_column,
    retype_column,
)
from tablechange.sources.inventory import (
    catalog_inventory,
    field_inventory,
    file_inventory,
    file_schema_inventory,
    frame_inventory,
    list_files,
    schema_inventory,
    with_file_row_counts,
)


def inventory(spark, tables):
    rows = [(t, i, c, ty, True) for t, cols in tables.items() for i, (c, ty) in enumerate(cols.items(), start=1)]
    return spark.createDataFrame(rows, "dataset string, ordinal int, `column` string, type string, nullable boolean")


def shown(df):
    return sorted((tuple(r) for r in df.select("kind", "scope", "key", "old_key", "destructive").collect()), key=repr)


def test_datasets_and_columns(spark):
    old = inventory(spark, {"users": {"id": "int", "name": "string", "age": "int"}, "gone": {"a": "int"}, "customer_orders": {"id": "int", "total": "double"}})
    new = inventory(spark, {"users": {"id": "bigint", "names": "string", "email": "string"}, "fresh": {"b": "int"}, "customer_order": {"id": "int", "total_price": "float"}})
    assert shown(diff_schemas(old, new)) == sorted(
        [
            ("create", "fresh", "fresh", None, False),
            ("drop", "gone", "gone", None, True),
            ("rename", "customer_order", "customer_order", "customer_orders", False),
            ("rename_column", "customer_order", "total_price", "total", False),
            ("retype_column", "customer_order", "total_price", "total", True),
            ("rename_column", "users", "names", "name", False),
            ("retype_column", "users", "id", None, False),
            ("add_column", "users", "email", None, False),
            ("drop_column", "users", "age", None, True),
        ],
        key=repr,
    )


def test_no_change_and_nullability(spark):
    old = inventory(spark, {"t": {"a": "int"}})
    assert diff_schemas(old, old).count() == 0
    new = old.withColumn("nullable", F.lit(False))
    assert diff_schemas(old, new).count() == 0
    assert [r["new_value"] for r in diff_schemas(old, new, compare_nullable=True).collect()] == ["int NOT NULL"]


def test_type_growth(spark):
    pairs = {
        ("int", "bigint"): True, ("bigint", "int"): False, ("int", "string"): True, ("string", "int"): False,
        ("float", "double"): True, ("bigint", "double"): False, ("int", "decimal(10,0)"): True, ("int", "decimal(9,0)"): False,
        ("decimal(10,2)", "decimal(12,4)"): True, ("decimal(10,2)", "decimal(10,4)"): False, ("date", "timestamp_ntz"): True,
        ("timestamp_ntz", "date"): False, ("double", "decimal(38,10)"): False,
    }
    df = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", keeps_values(F.col("a"), F.col("b")).alias("ok"))
    assert {(r["a"], r["b"]): r["ok"] for r in df.collect()} == pairs


def test_single_column_steps(spark):
    df = spark.createDataFrame([("1", 1), ("x", 2)], "a string, `b.c` int")
    assert add_column(df, "n", "date").schema["n"].dataType.simpleString() == "date"
    assert drop_column(df, "a").columns == ["b.c"]
    assert rename_column(df, "b.c", "d").columns == ["a", "d"]
    assert [r["a"] for r in retype_column(df, "a", "int", on_error="null").collect()] == [1, None]
    with pytest.raises(Exception, match="cannot cast"):
        retype_column(df, "a", "int").collect()
    for bad in (lambda: add_column(df, "a", "int"), lambda: drop_column(df, "z"), lambda: rename_column(df, "a", "b.c")):
        with pytest.raises(ValueError):
            bad()
    assert lost_values(df, {"a": "int"}) == {"a": 1}


def test_evolve(spark):
    df = spark.createDataFrame([(1, "x", 2.5, 300), (2, "y", None, 4)], "id int, nam string, price double, small int")
    target = spark.createDataFrame([], "id bigint, name string, price int, small tinyint, extra date")
    changes = diff_schemas(frame_inventory(spark, {"t": df}), frame_inventory(spark, {"t": target}))
    safe = evolve(df, changes)
    # 2.5 and 300 have no place in the narrower types
    assert [f.dataType.simpleString() for f in safe.schema] == ["bigint", "string", "double", "int", "date"]
    assert safe.columns == ["id", "name", "price", "small", "extra"]
    with pytest.raises(Exception, match="cannot cast"):
        evolve(df, changes, force_drop=True).collect()
    forced = evolve(df, changes, force_drop=True, on_error="null", columns=["extra", "id"])
    assert forced.columns[:2] == ["extra", "id"]
    assert [tuple(r) for r in forced.orderBy("id").select("price", "small").collect()] == [(2, None), (None, 4)]


def test_evolve_keeps_values_under_swapped_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    from tablechange.operators.diff import change_rows

    swap = change_rows(spark.createDataFrame([("rename_column", "b", "a"), ("rename_column", "a", "b")], "kind string, key string, old_key string"))
    assert evolve(df, swap).first().asDict() == {"b": 1, "a": 2}


def test_file_inventory_shows_drift(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, v string").coalesce(1).write.parquet(str(tmp_path / "d/p=1"))
    spark.createDataFrame([(1, 2.0), (2, 3.0)], "id bigint, v double").coalesce(1).write.parquet(str(tmp_path / "d/p=2"))
    got = file_schema_inventory(list_files(spark, str(tmp_path / "d"))).collect()
    assert {("p=1" in r["file"], r["column"], r["type"], r["num_rows"]) for r in got} == {
        (True, "id", "int32", 1), (True, "v", "string", 1), (False, "id", "int64", 2), (False, "v", "double", 2),
    }
    plain = spark.createDataFrame([(r["file"].removeprefix("file://"),) for r in got], "path string")
    assert file_schema_inventory(plain.distinct()).count() == 4
    assert schema_inventory(spark, {"one": str(tmp_path / "d/p=1")}).count() == 2


def test_file_inventory_counts_values_and_shows_missing_columns(spark, tmp_path):
    root = str(tmp_path / "d")
    for part, rows, schema in (
        ("p=1", [(1, "a"), (2, None)], "id int, v string"),
        ("p=2", [("b", 3, 1.5)], "v string, id int, `w x` double"),
        ("p=3", [(4, None)], "id int, v string"),
        ("p=4", [(5, [1])], "id bigint, v array<int>"),
        ("p=5", [], "id int, v string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{part}")
    files = list_files(spark, root)
    got = {(re.search("p=(.)", r["file"]).group(1), r["column"]): tuple(r)[1:2] + tuple(r)[3:] for r in file_inventory(files.union(files)).collect()}
    assert got.pop(("5", None)) == (None, None, 0, None, None)
    assert got == {
        ("1", "id"): (1, "int", 2, 2, False), ("1", "v"): (2, "string", 2, 1, False), ("1", "w x"): (None, "double", 2, 0, True),
        ("2", "v"): (1, "string", 1, 1, False), ("2", "id"): (2, "int", 1, 1, False), ("2", "w x"): (3, "double", 1, 1, False),
        ("3", "id"): (1, "int", 1, 1, False), ("3", "v"): (2, "string", 1, 0, False), ("3", "w x"): (None, "double", 1, 0, True),
        ("4", "id"): (1, "bigint", 1, 1, False), ("4", "v"): (2, "array<int>", 1, 1, False), ("4", "w x"): (None, "double", 1, 0, True),
    }
    assert file_inventory(files.limit(0)).count() == 0
    odd = str(tmp_path / "odd")
    spark.range(3).coalesce(1).write.parquet(f"{odd}/a b%20=c+d")
    assert [(r["n_values"], "a b%20=c+d/" in r["file"]) for r in file_inventory(list_files(spark, odd)).collect()] == [(3, True)]
    names = spark.createDataFrame([("p=1",), ("p=4",), ("none",)], "dataset string")
    counted = with_file_row_counts(names, root, "/(p=.)/").collect()
    assert {r["dataset"]: r["num_rows"] for r in counted} == {"p=1": 2, "p=4": 1, "none": None}


def test_catalog_inventory(spark):
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("seen_here")
    got = [tuple(r)[:4] for r in catalog_inventory(spark).filter("dataset = 'seen_here'").collect()]
    assert got == [("seen_here", 1, "id", "int")]
    spark.catalog.dropTempView("seen_here")


def test_fields_of_json(spark):
    rows = [("g", '{"a": 1, "b": "1", "c": null, "d": 1.5, "e": true, "f": {}, "h": []}'), ("g", '{"a": 2}'), ("g", "no json"), ("g", None), ("g", "[1]")]
    got = {(r["field"], r["json_type"]): (r["n"], r["n_null"]) for r in field_inventory(spark.createDataFrame(rows, "k string, j string"), "j", ["k"]).collect()}
    assert got == {
        ("a", "integer"): (2, 0), ("b", "string"): (1, 0), ("c", "null"): (1, 1), ("d", "number"): (1, 0),
        ("e", "boolean"): (1, 0), ("f", "object"): (1, 0), ("h", "array"): (1, 0),
    }


def test_nullability_through_evolve(spark):
    schema = "dataset string, ordinal int, column string, type string, nullable boolean"
    old = spark.createDataFrame([("t", 1, "a", "int", True), ("t", 2, "b", "int", True)], schema)
    new = spark.createDataFrame([("t", 1, "a", "bigint", False), ("t", 2, "b", "int", False), ("t", 3, "my col", "string", False)], schema)
    changes = diff_schemas(old, new, compare_nullable=True)
    assert {r["key"]: (r["new_value"], r["destructive"]) for r in changes.collect()} == {
        "a": ("bigint NOT NULL", True), "b": ("int NOT NULL", True), "my col": ("string NOT NULL", False),
    }
    full = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in evolve(full, changes).schema] == ["a bigint", "b int", "my col string"]
    gaps = spark.createDataFrame([(None, None)], "a int, b int")
    assert evolve(gaps, changes).schema["a"].dataType.simpleString() == "int"  # a required column with nulls waits
    created = diff_schemas(old.limit(0), new)
    assert created.filter("kind = 'create'").first()["new_value"] == "a bigint, b int, `my col` string"
