import numpy as np
from pyspark.sql import functions as F, types as T

from tablechange.llm import ann
from tablechange.llm.ann import balanced_parts, learn_partitions, nearest, nearest_neighbours
from tablechange.llm.queries import QUERIES


def brute(rows, is_query, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault((i, tuple(np.float32(x) for x in v)), None)
    size = {}
    for _, v in fine:
        size[len(v)] = size.get(len(v), 0) + 1
    most = max(size, key=size.get)
    fine = [(i, np.array(v, float)) for i, v in fine if len(v) == most]
    out = {}
    for i, v in fine:
        if is_query(i):
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in fine if j != i)[:k]
    return out


def frame(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], schema)


def check(got, want, recall):
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(lists.pop(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        ids = {j for _, j in best}
        hits += sum(i in ids for _, _, i in mine)
        total += len(best)
    assert not lists and hits >= recall * total, (hits, total)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf")] + [0.0] * 3), (205, [1.0]), (None, [1.0] * 4), (5, rows[5][1])]
    df = frame(spark, rows)
    got = nearest_neighbours(df, F.col("vec_id") % 10 == 0).collect()
    check(got, brute(rows, lambda i: i % 10 == 0, 10), 1.0)
    few = rows[:4]
    check(nearest_neighbours(frame(spark, few), F.col("vec_id") == 0).collect(), brute(few, lambda i: i == 0, 10), 1.0)
    assert nearest_neighbours(frame(spark, []), F.lit(True)).count() == 0
    assert nearest_neighbours(frame(spark, rows[40:41]), F.lit(True)).count() == 0


def test_short_lists_are_filled(spark, monkeypatch):
    """A router that sends three vectors into a part of their own, and one vector into a part without any other."""
    ways = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    fixed = ann.Router(1.0, ways, np.zeros(3), np.eye(3), np.zeros(3), 1)
    monkeypatch.setattr(ann, "learn_partitions", lambda *args: fixed)
    rng = np.random.default_rng(3)
    rows = [(i, [9.0 + i, 0.0, 1.0]) for i in range(3)] + [(3, [0.0, 9.0, 0.0])]
    rows += [(i, [0.0, 1.0, float(8 + x)]) for i, x in zip(range(4, 60), rng.normal(size=56))]
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") < 6).collect()
    check(got, brute(rows, lambda i: i < 6, 10), 1.0)


def test_large_components_and_repeated_ids(spark):
    rows = [(i, [1e200 * (i + 1), 1e199]) for i in range(12)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 4, k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 5, 2] and np.allclose([r["score"] / 1e200 for r in got], [1, 1, 2])
    same = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = nearest_neighbours(same, F.lit(True)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1, 1.0)] * 2


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1, (100, 8)) for c in (0, 20, 40, 60)])
    part = balanced_parts(points, nearest(points, points, 5), 4)
    assert np.bincount(part).tolist() == [100] * 4
    assert all(len(set(part[a : a + 100])) == 1 for a in range(0, 400, 100))
    assert learn_partitions(points, 4).probes == 1


def test_query_reaches_the_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op7_nearest_neighbours"](spark, sf).collect()
    check(got, brute(rows, lambda i: i % 100 == 0, 10), 0.9)
