import pytest
from pyspark.sql import functions as F

from tablechange.operators.diff import diff
from tablechange.sources import hashtree
from tablechange.sources.hashtree import diff_hashed, differing_leaves, load_hash_tree, rows_of_leaves, save_hashed_snapshot


def table(spark, n):
    return spark.range(n).select("id", (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("w"))


def edited(df):
    changed = df.withColumn("v", F.when(F.col("id") % 1000 == 1, "new").otherwise(F.col("v"))).withColumn("w", F.when(F.col("id") % 2000 != 2, F.col("w")))
    return changed.filter("id % 1000 <> 3").unionByName(df.limit(1).select((F.col("id") + 10**9).alias("id"), "v", "w"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 40, 20_000])
def test_same_rows_as_diff(spark, tmp_path, n):
    old, path = table(spark, n), str(tmp_path / "s")
    save_hashed_snapshot(old, path, 1, ["id"])
    save_hashed_snapshot(edited(old), path, 2, ["id"], like=1)
    save_hashed_snapshot(old.repartition(5), path, 3, ["id"], like=1)
    assert rows(diff_hashed(spark, path, 1, 2)) == rows(diff(old, edited(old), ["id"]))
    assert rows(diff_hashed(spark, path, 2, 1)) == rows(diff(edited(old), old, ["id"]))
    assert rows(diff_hashed(spark, path, 1, 3)) == []


def scanned(df):
    """Rows that the scan of a plan without shuffles hands on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_rows_are_read(spark, tmp_path):
    """One row in a thousand changed: under a twentieth of the rows is read."""
    n, path = 100_000, str(tmp_path / "s")
    old = table(spark, n)
    one = save_hashed_snapshot(old, path, 1, ["id"], leaf_rows=20)
    two = save_hashed_snapshot(old.withColumn("v", F.when(F.col("id") % 1000 == 1, "new").otherwise(F.col("v"))), path, 2, ["id"], like=1)
    leaves = differing_leaves(spark, one, two)
    assert leaves.count() <= 100
    found = rows_of_leaves(spark, one, leaves)
    assert found.count() <= n // 20
    assert scanned(rows_of_leaves(spark, one, leaves)) <= n // 20


def test_many_leaves_and_other_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hashtree, "_NAMED_LEAVES", 3)
    old, path = table(spark, 5000), str(tmp_path / "s")
    save_hashed_snapshot(old, path, 1, ["id"])
    save_hashed_snapshot(edited(old), path, 2, ["id"], like=1)
    assert rows(diff_hashed(spark, path, 1, 2, ["v"])) == rows(diff(old, edited(old), ["id"], ["v"]))
    tree = save_hashed_snapshot(old, path, 3, ["id"], leaf_rows=500)
    assert tree.bits < load_hash_tree(spark, path, 1).bits
    with pytest.raises(ValueError, match="same keys and leaves"):
        diff_hashed(spark, path, 1, 3)
    with pytest.raises(Exception, match="exists"):
        save_hashed_snapshot(old, path, 3, ["id"])


def test_compound_keys_and_nested_values(spark, tmp_path):
    schema = "a string, b int, m map<string,int>, s struct<x:int,y:array<string>>"
    old = spark.createDataFrame([(f"k{i % 4}", i, {"p": i}, (i, ["q"])) for i in range(200)], schema)
    new = old.withColumn("m", F.when(F.col("b") == 7, F.create_map(F.lit("p"), F.lit(-1))).otherwise(F.col("m")))
    path = str(tmp_path / "s")
    save_hashed_snapshot(old, path, 1, ["a", "b"])
    save_hashed_snapshot(new, path, 2, ["a", "b"], like=1)
    assert [(r["key"], r["column"]) for r in diff_hashed(spark, path, 1, 2).collect()] == [("k3.7", "m")]
