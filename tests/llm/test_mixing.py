import pytest
from pyspark.sql import functions as F, types as T

from tablechange.llm.mixing import labelled_sample, mix, mix_rates
from tablechange.llm.queries import QUERIES, TARGETS

A, B = "alpha beta gamma delta", "uno dos tres cuatro"
GOAL = {"a": 0.5, "b": 0.5}


def frame(spark, rows):
    names = ["text", "lang", "domain", "rate", "tokens", "__x"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in rows], schema)


def labelled(spark):
    return spark.createDataFrame([(A, "a"), (B, "b"), (None, "a"), ("x", None), ("y", "other")], "text string, domain string")


def shares(rows, n):
    total = sum(r["tokens"] for r in rows)
    return [sum(r["tokens"] * r["rate"] * r["posterior"][k] for r in rows) / total for k in range(n)]


def test_rates_meet_the_targets(spark):
    rows = [(i, A) for i in range(30)] + [(100 + i, B + " " + B) for i in range(5)] + [(200, A + " " + B), (300, None), (301, ""), (7, A), (None, "beta dos")]
    got = mix_rates(frame(spark, rows), labelled(spark), GOAL).collect()
    assert len(got) == len(rows)
    assert shares(got, 2) == pytest.approx([0.5, 0.5], abs=1e-3)
    assert all(r["rate"] >= 0 for r in got)
    assert {r["domain"] for r in got if r["doc_id"] is not None and r["doc_id"] < 100} == {"a"}
    assert len({r["rate"] for r in got if r["doc_id"] == 7}) == 1
    assert {r["tokens"] for r in got if r["doc_id"] in (300, 301)} == {0}


def test_least_squares_with_a_bound(spark):
    """A domain that is not wanted gets rate zero, not less."""
    rows = [(i, A) for i in range(10)] + [(100 + i, B) for i in range(10)]
    got = mix_rates(frame(spark, rows), labelled(spark), {"a": 1.0, "b": 0.0}).collect()
    assert all(r["rate"] < 0.02 for r in got if r["doc_id"] >= 100)
    assert shares(got, 2)[0] == pytest.approx(1, abs=0.01)


def test_degenerate_tables(spark):
    nothing = spark.createDataFrame([], "text string, domain string")
    assert mix_rates(frame(spark, []), labelled(spark), GOAL).count() == 0
    got = mix_rates(frame(spark, [(1, A), (2, None)]), nothing, GOAL).collect()
    assert [r["rate"] for r in got] == [1.0, 1.0]
    assert mix_rates(frame(spark, [(1, None)]), labelled(spark), GOAL).first()["tokens"] == 0


def test_mix_keeps_columns_and_is_repeatable(spark):
    docs = frame(spark, [(i, A) for i in range(300)] + [(1000 + i, B) for i in range(100)])
    out = mix(docs, labelled(spark), GOAL)
    assert out.columns == docs.columns
    first, again = sorted(map(tuple, out.collect())), sorted(map(tuple, mix(docs.repartition(5), labelled(spark), GOAL).collect()))
    assert first == again
    n = sum(r[0] < 1000 for r in first)
    assert abs(n - 200) < 40 and len(first) - n >= 200 - 5 and {r[0] for r in first if r[0] >= 1000} == set(range(1000, 1100))


def test_sample_is_bounded(spark):
    docs = frame(spark, [(i, A) for i in range(50)])
    ids = spark.range(50).select(F.col("id").alias("doc_id"))
    some = labelled_sample(docs, ids, max_train=10)
    assert some.count() == 10 and some.columns == docs.columns


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op4_mixing"](spark, sf).collect()
    assert len(got) == docs.count()
    assert shares(got, 4) == pytest.approx(list(TARGETS.values()), abs=2e-3)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sum(lang[r["doc_id"]] == r["domain"] for r in got) / len(got) > 0.8
