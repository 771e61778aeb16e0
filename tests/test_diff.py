import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablechange.operators.diff import CHANGE_SCHEMA, changed, created, diff, diff_bags, diff_definitions, dropped, is_empty
from tablechange.operators.merge import apply_changes, apply_until_stable
from tablechange.sources.snapshots import SnapshotKeyError, keyed_snapshot, load_snapshot, qualified_name, save_snapshot

SCHEMA = "k string, a int, b double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OLD = [("a", 1, 1.0), ("b", None, 2.0), ("c", 3, None), ("d", 4, 4.0)]
NEW = [("a", 1, 1.0), ("b", 5, 2.0), ("c", None, 3.5), ("e", 6, 6.0)]


def test_diff_kinds_and_values(spark):
    got = rows(diff(frame(spark, OLD), frame(spark, NEW), ["k"], with_same=True).select("kind", "key", "column", "old_value", "new_value"))
    assert got == sorted(
        [
            ("same", "a", None, "a=1, b=1", "a=1, b=1"),
            ("change", "b", "a", None, "5"),
            ("change", "c", "a", "3", None),
            ("change", "c", "b", None, "3.5"),
            ("drop", "d", None, "a=4, b=4", None),
            ("create", "e", None, None, "a=6, b=6"),
        ],
        key=repr,
    )


def test_schema_and_flags(spark):
    changes = diff(frame(spark, OLD), frame(spark, NEW), ["k"])
    assert [(f.name, f.dataType) for f in changes.schema] == [(f.name, f.dataType) for f in CHANGE_SCHEMA]
    assert {r["kind"]: r["destructive"] for r in changes.collect()} == {"create": False, "change": False, "drop": True}


def test_diff_of_equal_sides_is_empty(spark):
    assert is_empty(diff(frame(spark, OLD), frame(spark, OLD), ["k"]))
    assert is_empty(diff(frame(spark, OLD), frame(spark, OLD), ["k"], with_same=True))


def test_empty_side(spark):
    none = frame(spark, [])
    assert {r["kind"] for r in diff(none, frame(spark, NEW), ["k"]).collect()} == {"create"}
    assert {r["kind"] for r in diff(frame(spark, NEW), none, ["k"]).collect()} == {"drop"}
    assert rows(created(none, frame(spark, NEW), ["k"])) == sorted(NEW, key=repr)
    assert rows(dropped(none, frame(spark, NEW), ["k"])) == []


def test_maps_and_arrays_compare_by_content(spark):
    schema = "k int, m map<string,int>, x array<int>"
    old = frame(spark, [(1, {"a": 1, "b": 2}, [1, 2]), (2, {"a": 1}, [1])], schema)
    new = frame(spark, [(1, {"b": 2, "a": 1}, [1, 2]), (2, {"a": 2}, [2])], schema)
    assert sorted(r["column"] for r in changed(old, new, ["k"]).collect()) == ["m", "x"]
    assert rows(diff(old, new, ["k"], digest_first=True).select("key", "column")) == [("2", "m"), ("2", "x")]


def test_digest_sees_nulls_and_order(spark):
    schema = "k int, a string, b string"
    old = frame(spark, [(1, None, "x"), (2, "x", None), (3, "x", "y"), (4, "", None), (5, "x", "x")], schema)
    new = frame(spark, [(1, "x", None), (2, "x", None), (3, "y", "x"), (4, None, ""), (5, "x", "x")], schema)
    plain = diff(old, new, ["k"]).select("kind", "key", "column", "old_value", "new_value")
    digest = diff(old, new, ["k"], digest_first=True).select("kind", "key", "column", "old_value", "new_value")
    assert rows(plain) == rows(digest)
    assert {r["key"] for r in plain.collect()} == {"1", "3", "4"}


def test_compound_keys_do_not_collide(spark):
    schema = "x string, y string, v int"
    old = frame(spark, [("a.b", "c", 1), ("a", "b.c", 2)], schema)
    new = frame(spark, [("a.b", "c", 1), ("a", "b.c", 3)], schema)
    changes = diff(old, new, ["x", "y"])
    assert [r["key"] for r in changes.collect()] == [r"a.b\.c"]
    assert rows(apply_changes(old, new, changes, ["x", "y"])) == rows(new)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b"):
        diff(frame(spark, OLD).drop("b"), frame(spark, NEW), ["k"])


def test_duplicate_and_null_keys_raise(spark):
    with pytest.raises(SnapshotKeyError):
        keyed_snapshot(frame(spark, OLD + [("a", 9, 9.0)]), ["k"], ["a"])
    with pytest.raises(SnapshotKeyError):
        keyed_snapshot(frame(spark, OLD + [(None, 9, 9.0)]), ["k"], ["a"])
    assert keyed_snapshot(frame(spark, OLD), ["k"], ["a"]).columns == ["k", "a"]


def test_qualified_name(spark):
    df = frame(spark, [("main", "t"), ("s", "t")], "ns string, n string")
    assert rows(df.select(qualified_name(F.col("ns"), F.col("n")))) == [("s.t",), ("t",)]


def test_snapshot_versions(spark, tmp_path):
    save_snapshot(frame(spark, OLD), str(tmp_path / "s"), 1)
    save_snapshot(frame(spark, NEW), str(tmp_path / "s"), 2)
    assert rows(load_snapshot(spark, str(tmp_path / "s"), 1)) == sorted(OLD, key=repr)
    with pytest.raises(Exception, match="exist"):
        save_snapshot(frame(spark, NEW), str(tmp_path / "s"), 1)


def test_bags_count_copies(spark):
    old = frame(spark, [("a", 1, None)] * 5 + [("b", 1, 1.0)])
    new = frame(spark, [("a", 1, None)] * 2 + [("b", 1, 1.0)] * 3)
    assert rows(diff_bags(old, new)) == [("create", "b", 1, 1.0, 2), ("drop", "a", 1, None, 3)]


def test_definitions(spark):
    schema = "name string, definition string"
    old = frame(spark, [("v", "SELECT 1"), ("w", "SELECT  2"), ("x", "SELECT 3")], schema)
    new = frame(spark, [("v", "SELECT 10"), ("w", "select 2"), ("y", "SELECT 4")], schema)
    assert rows(diff_definitions(old, new).select("kind", "key")) == [("drop", "x"), ("replace", "v"), ("replace", "w"), ("replace", "y")]
    quoted = [spark.createDataFrame([("v", f"SELECT  '{x}'"), ("w", f"{k} 'A'")], "name string, definition string") for x, k in (("a", "select"), ("A", "SELECT  "))]
    assert rows(diff_definitions(*quoted, quotes=True).select("kind", "key")) == [("replace", "v")]
    assert rows(diff_definitions(old, new, canonical=True).select("kind", "key")) == [("drop", "x"), ("replace", "v"), ("replace", "y")]


values = st.dictionaries(
    st.sampled_from("abcdefgh"), st.tuples(st.one_of(st.none(), st.integers(-2, 2)), st.one_of(st.none(), st.sampled_from([0.5, -1.0]))), max_size=8
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, values)
def test_laws(spark, a, b):
    old = frame(spark, [(k, *v) for k, v in a.items()])
    new = frame(spark, [(k, *v) for k, v in b.items()])
    there = rows(diff(old, new, ["k"]).select("kind", "key", "column", "old_value", "new_value"))
    back = rows(diff(new, old, ["k"]).select("kind", "key", "column", "new_value", "old_value"))
    swap = {"create": "drop", "drop": "create", "change": "change"}
    assert there == sorted([(swap[r[0]], *r[1:]) for r in back], key=repr)
    changes = diff(old, new, ["k"])
    assert rows(apply_changes(old, new, changes, ["k"], force_drop=True)) == rows(new)
    safe = {r[0] for r in rows(apply_changes(old, new, changes, ["k"]))}
    assert safe == set(a) | set(b)


def test_apply_until_stable(spark):
    result, left, rounds = apply_until_stable(frame(spark, OLD), frame(spark, NEW), ["k"], force_drop=True)
    assert rows(result) == sorted(NEW, key=repr) and is_empty(left) and rounds == 1
    _, left, rounds = apply_until_stable(frame(spark, OLD), frame(spark, OLD), ["k"])
    assert rounds == 0 and is_empty(left)


def test_unselected_locked_and_ignored_are_not_applied(spark):
    changes = diff(frame(spark, OLD), frame(spark, NEW), ["k"])
    for flag, value in (("selected", False), ("locked", True), ("ignored", True)):
        held = changes.withColumn(flag, F.when(F.col("key") == "b", value).otherwise(F.col(flag)))
        got = {r["k"]: r["a"] for r in apply_changes(frame(spark, OLD), frame(spark, NEW), held, ["k"]).collect()}
        assert got == {"a": 1, "b": None, "c": None, "d": 4, "e": 6}


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_same_result_under_any_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        old, new = frame(spark, OLD[::-1]).repartition(3), frame(spark, NEW).repartition(2)
        assert rows(diff(old, new, ["k"])) == rows(diff(frame(spark, OLD), frame(spark, NEW), ["k"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_variant_attributes(spark):
    old = spark.sql("SELECT 1 AS k, parse_json('{\"a\": 1}') AS v UNION ALL SELECT 2, parse_json('[1]') UNION ALL SELECT 3, null")
    new = spark.sql("SELECT 1 AS k, parse_json('{\"a\": 2}') AS v UNION ALL SELECT 2, parse_json('[1]') UNION ALL SELECT 3, null")
    assert [(r["kind"], r["key"], r["column"]) for r in diff(old, new, ["k"]).collect()] == [("change", "1", "v")]


def test_digests_first_shuffle_keys_only(spark):
    old = spark.range(1000).selectExpr("id AS k", "repeat(cast(id AS string), 50) AS body")
    new = old.selectExpr("k", "CASE WHEN k = 7 THEN 'other' ELSE body END AS body")
    rows = diff(old, new, ["k"], digest_first=True)
    assert [(r["kind"], r["key"]) for r in rows.collect()] == [("change", "7")]
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
