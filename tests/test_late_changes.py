import itertools
import random

import pytest

from tablechange.sources.publish import current_version, list_published, publish, read_dataset, read_marks, rename_dataset
from tablechange.streaming.changes import apply_batch

ROW = "id int, v string"
CHANGE = "id int, v string, op string, n int"


@pytest.fixture()
def base(tmp_path):
    return str(tmp_path / "base")


def rows(spark, base, name="t"):
    return sorted(tuple(r) for r in read_dataset(spark, base, name).collect())


def newest(start, changes):
    """The rows of one run over all changes; of equal orders the last one counts."""
    out, order = dict(start), {}
    for i, v, op, n in changes:
        if n >= order.get(i, n):
            order[i] = n
            out.pop(i, None)
            if op == "upsert":
                out[i] = v
    return sorted(out.items())


@pytest.mark.parametrize("buckets", [0, 4])
def test_late_changes_change_nothing(spark, base, buckets):
    kept = {"keys": ["id"], "buckets": buckets} if buckets else {}
    publish(spark.createDataFrame([(1, "a"), (2, "b")], ROW), base, "t", **kept)
    run = apply_batch(base, "t", ["id"], ["n"], stream="s")
    deliveries = [
        [(1, "new", "upsert", 5), (2, None, "delete", 5), (3, "c", "upsert", 5)],
        [(1, "late", "upsert", 2), (2, "late", "upsert", 3), (3, None, "delete", 4), (4, "d", "upsert", 1)],
        [(4, None, "delete", 0), (2, "back", "upsert", 6)],
        [(2, "late again", "upsert", 5)],
    ]
    for k, changes in enumerate(deliveries):
        run(spark.createDataFrame(changes, CHANGE), k)
        assert rows(spark, base) == newest([(1, "a"), (2, "b")], itertools.chain(*deliveries[: k + 1]))
    assert rows(spark, base) == [(1, "new"), (2, "back"), (3, "c"), (4, "d")]
    assert sorted((r["id"], r["__order"]["n"]) for r in read_marks(spark, current_version(spark, base, "t")).collect()) == [(1, 5), (2, 6), (3, 5), (4, 1)]


def test_any_order_of_delivery_gives_the_rows_of_one_run(spark, base):
    rng = random.Random(2)
    changes = [(rng.randrange(6), f"v{n}", rng.choice(["upsert", "upsert", "delete"]), n) for n in range(24)]
    want = newest([(0, "a"), (9, "z")], changes)
    rng.shuffle(changes)
    for name, size in (("many", 4), ("one", 24)):
        publish(spark.createDataFrame([(0, "a"), (9, "z")], ROW), base, name, keys=["id"], buckets=3)
        run = apply_batch(base, name, ["id"], ["n"], stream="s")
        for k in range(0, 24, size):
            run(spark.createDataFrame(changes[k : k + size], CHANGE), k)
        assert rows(spark, base, name) == want


def test_orders_outlive_other_streams_publishing_buckets_and_names(spark, base):
    publish(spark.createDataFrame([(1, "a"), (2, "b")], ROW), base, "t", keys=["id"], buckets=4)
    apply_batch(base, "t", ["id"], ["n"], stream="one")(spark.createDataFrame([(1, "x", "upsert", 5), (2, None, "delete", 5)], CHANGE), 0)
    publish(read_dataset(spark, base, "t"), base, "t", keys=["id"], buckets=7)  # other buckets: the orders move with the next batch
    apply_batch(base, "t", ["id"], ["n"], stream="two")(spark.createDataFrame([(1, "late", "upsert", 4), (2, "late", "upsert", 4)], CHANGE), 0)
    assert rows(spark, base) == [(1, "x")]
    rename_dataset(spark, base, "t", "u")
    publish(read_dataset(spark, base, "u"), base, "u")  # no buckets any more
    apply_batch(base, "u", ["id"], ["n"], stream="two")(spark.createDataFrame([(2, "late", "upsert", 3), (3, "c", "upsert", 1)], CHANGE), 1)
    assert rows(spark, base, "u") == [(1, "x"), (3, "c")] and list_published(spark, base) == ["u"]


def test_rows_have_the_age_of_their_own_order_columns(spark, base):
    publish(spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, v string, n int"), base, "t")
    run = apply_batch(base, "t", ["id"], ["n"], stream="s")
    change = "id int, v string, n int, op string"
    run(spark.createDataFrame([(1, "late", 4, "upsert"), (2, "x", 1, "upsert")], change), 0)
    assert rows(spark, base) == [(1, "a", 5), (2, "x", 1)]
    publish(spark.createDataFrame([(2, "by hand", 9)], "id int, v string, n int"), base, "t")
    run(spark.createDataFrame([(2, "late", 8, "upsert"), (1, "late", 3, "delete")], change), 1)
    assert rows(spark, base) == [(2, "by hand", 9)]


def test_compound_keys_and_orders(spark, base):
    publish(spark.createDataFrame([("a", 1, 0)], "k string, j int, v int"), base, "t", keys=["k", "j"], buckets=2)
    run = apply_batch(base, "t", ["k", "j"], ["day", "n"], stream="s")
    change = "k string, j int, v int, op string, day string, n long"
    run(spark.createDataFrame([("a", 1, 1, "upsert", "2024-01-02", 1)], change), 0)
    run(spark.createDataFrame([("a", 1, 2, "upsert", "2024-01-01", 9), ("a", 2, 3, "upsert", "2024-01-01", 9)], change), 1)
    run(spark.createDataFrame([("a", 1, 4, "upsert", "2024-01-02", 2)], change), 2)
    assert rows(spark, base) == [("a", 1, 4), ("a", 2, 3)]
