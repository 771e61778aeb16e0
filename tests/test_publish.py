import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablechange.operators.explore import list_datasets, prefix_lookup, preview, run_sql, text_widths, vocabulary
from tablechange.operators.models import build_functions, build_models, fill_variables
from tablechange.sources.export import append_run_log, export_csv, run_stats
from tablechange.sources.publish import (
    PublishError,
    create_dataset,
    current_version,
    drop_dataset,
    list_published,
    publish,
    read_dataset,
    rename_dataset,
)
from tablechange.streaming.changes import apply_batch, run_to_table, stream_apply_changes, stream_field_inventory, stream_schema_drift


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture()
def base(tmp_path):
    return str(tmp_path / "base")


def test_publish_reads_its_own_input_and_rolls_back(spark, base):
    publish(spark.range(3), base, "t")
    publish(read_dataset(spark, base, "t").filter("id > 0"), base, "t", validate=lambda df: df.count() == 2)
    assert ids(read_dataset(spark, base, "t")) == [1, 2]
    for check in (lambda df: False, lambda df: 1 / 0):
        with pytest.raises(PublishError):
            publish(spark.range(9), base, "t", validate=check)
    with pytest.raises(PublishError):
        publish(spark.range(9).select((F.lit(1) / F.raise_error(F.lit("broken"))).alias("id")), base, "t")
    assert ids(read_dataset(spark, base, "t")) == [1, 2]
    assert current_version(spark, base, "t").version == 2


def test_two_writers_cannot_take_the_same_number(spark, base):
    publish(spark.range(1), base, "t")

    def other_writer_first(df):
        publish(spark.range(5), base, "t")

    with pytest.raises(PublishError, match="another writer"):
        publish(spark.range(2), base, "t", validate=other_writer_first)
    assert ids(read_dataset(spark, base, "t")) == [0, 1, 2, 3, 4]


def test_lifecycle(spark, base):
    create_dataset(spark, base, "s.t", "id bigint")
    assert read_dataset(spark, base, "s.t").count() == 0
    with pytest.raises(PublishError):
        create_dataset(spark, base, "s.t", "id bigint")
    publish(spark.range(2), base, "s.t")
    rename_dataset(spark, base, "s.t", "u")
    assert list_published(spark, base) == ["u"] and ids(read_dataset(spark, base, "u")) == [0, 1]
    with pytest.raises(LookupError):
        read_dataset(spark, base, "s.t")
    create_dataset(spark, base, "s.t", "id bigint")
    with pytest.raises(PublishError):
        rename_dataset(spark, base, "u", "s.t")
    with pytest.raises(PublishError):
        drop_dataset(spark, base, "u")
    drop_dataset(spark, base, "u", force_drop=True)
    assert list_published(spark, base) == ["s.t"]
    publish(spark.range(1), base, "u")
    assert ids(read_dataset(spark, base, "u")) == [0]


def test_models_in_any_order(spark, tmp_path):
    spark.range(4).createOrReplaceTempView("numbers")
    models = {"c": "SELECT sum(id) AS id FROM b", "b": "SELECT id * ${F} AS id FROM a", "a": "SELECT id FROM numbers WHERE id > 1"}
    assert ids(build_models(spark, models, variables={"F": "10"})["c"]) == [50]
    assert ids(build_models(spark, models, materialize=str(tmp_path / "m"), variables={"F": "1"})["c"]) == [5]
    assert ids(spark.read.parquet(str(tmp_path / "m/a"))) == [2, 3]
    with pytest.raises(AnalysisException, match="nowhere"):
        build_models(spark, {"a": "SELECT * FROM numbers", "b": "SELECT * FROM nowhere"})
    with pytest.raises(AnalysisException):
        build_models(spark, {"a": "SELECT * FROM b", "b": "SELECT * FROM a"})
    with pytest.raises(AnalysisException):
        build_models(spark, {"a": "SELECT missing_column FROM numbers"})
    assert fill_variables("${A}${B}", {"A": "${B}"}) == "${B}${B}"


def test_functions(spark):
    build_functions(spark, {"twice_two": "(x INT) RETURNS INT RETURN twice(twice(x))", "twice": "(x INT) RETURNS INT RETURN x * 2"})
    build_functions(spark, {"upto": "(n INT) RETURNS TABLE(i INT) RETURN SELECT explode(sequence(1, n))"})
    assert spark.sql("SELECT twice_two(3)").first()[0] == 12
    assert spark.sql("SELECT * FROM upto(3)").count() == 3


def test_run_sql_counts_in_the_same_pass(spark):
    df, info = run_sql(spark, "SELECT id FROM range(:n)", {"n": 7})
    assert info.columns == ["id"]
    assert len(df.collect()) == 7 and info.rows == 7 and info.seconds > 0


def test_preview_widths_and_listing(spark):
    df = spark.createDataFrame([(2, "größe"), (1, None), (3, "x" * 50)], "id int, text string")
    assert [tuple(r) for r in preview(df, ["id"], 2).collect()] == [("1", "NULL"), ("2", "größe")]
    assert {r["column"]: r["width"] for r in text_widths(df).collect()} == {"id": 4, "text": 30}
    assert {r["column"]: r["width"] for r in text_widths(df.filter("id < 3"), cap=100).collect()} == {"id": 4, "text": 9}
    df.createOrReplaceTempView("listed_view")
    assert ("view", "listed_view") in {(r["kind"], r["name"]) for r in list_datasets(spark).collect()}


def test_prefix_lookup(spark):
    terms = vocabulary([spark.createDataFrame([("Orders",), ("order_id",), ("x",), (None,)], "t string"), spark.createDataFrame([("x",)], "u string")])
    assert terms.count() == 3
    prefixes = spark.createDataFrame([("ORD",), ("order_",), ("",), ("xyz",)], "prefix string")
    assert {tuple(r) for r in prefix_lookup(terms, prefixes).collect()} == {("ORD", "Orders"), ("ORD", "order_id"), ("order_", "order_id")}


def test_csv_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, ""), (4, ' q"q ')], "id int, t string")
    export_csv(df.coalesce(1).sortWithinPartitions("id"), str(tmp_path / "csv"), single_file=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text() == 'id,t\n1,"a,b"\n2,NULL\n3,\n4," q""q "\n'


def test_run_log(spark, tmp_path):
    for q, s in (("SELECT 1", 1.0), ("select  1", 3.0), ("SELECT 2", 5.0)):
        append_run_log(spark, str(tmp_path / "log"), q, s)
    stats = run_stats(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert sorted((r["runs"], r["mean_seconds"], r["max_seconds"]) for r in stats) == [(1, 5.0, 5.0), (2, 2.0, 3.0)]


def test_stream_of_changes_with_replay(spark, base, tmp_path):
    publish(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), base, "t")
    schema = "id int, v string, op string, n int"
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1, "x", "upsert", 1), (1, "y", "upsert", 2), (2, "b", "delete", 1), (3, "c", "upsert", 1)], schema).coalesce(1).write.parquet(feed)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    stream_apply_changes(stream(), base, "t", ["id"], ["n"], str(tmp_path / "state"))
    assert sorted(tuple(r) for r in read_dataset(spark, base, "t").collect()) == [(1, "y"), (3, "c")]
    spark.createDataFrame([(3, "c", "delete", 5), (4, "d", "upsert", 5)], schema).coalesce(1).write.mode("append").parquet(feed)
    stream_apply_changes(stream(), base, "t", ["id"], ["n"], str(tmp_path / "state"))
    assert sorted(tuple(r) for r in read_dataset(spark, base, "t").collect()) == [(1, "y"), (4, "d")]
    before = current_version(spark, base, "t")
    (mark, last), = before.tags.items()
    again = apply_batch(base, "t", ["id"], ["n"], stream=mark.removeprefix("batch of "))
    again(spark.createDataFrame([(4, "z", "upsert", 9)], schema), last)
    assert current_version(spark, base, "t") == before  # a batch delivered again


@pytest.mark.parametrize("buckets", [0, 4])
def test_two_streams_and_an_ordinary_publish(spark, base, buckets):
    kept = {"keys": ["id"], "buckets": buckets} if buckets else {}
    schema = "id int, v string, op string, n int"
    publish(spark.createDataFrame([(1, "a")], "id int, v string"), base, "t", **kept)
    first, second = (apply_batch(base, "t", ["id"], ["n"], stream=s) for s in ("one", "two"))
    first(spark.createDataFrame([(2, "b", "upsert", 1)], schema), 0)
    second(spark.createDataFrame([(3, "c", "upsert", 1)], schema), 0)
    rows = lambda: sorted(tuple(r) for r in read_dataset(spark, base, "t").collect())
    assert rows() == [(1, "a"), (2, "b"), (3, "c")]
    publish(read_dataset(spark, base, "t").withColumn("v", F.upper("v")), base, "t", **kept)
    first(spark.createDataFrame([(2, "b", "upsert", 1)], schema), 0)  # delivered again after it
    assert rows() == [(1, "A"), (2, "B"), (3, "C")]
    first(spark.createDataFrame([(2, "z", "upsert", 1)], schema), 1)
    assert rows() == [(1, "A"), (2, "z"), (3, "C")]


def test_drift_of_a_null_group(spark, tmp_path):
    from datetime import datetime

    feed, schema = str(tmp_path / "feed"), "ts timestamp_ntz, g string, j string"
    days = [datetime(2024, 1, 4), datetime(2024, 3, 1)]
    spark.createDataFrame([(d, g, '{"k": 1, "x": 2}') for d in days for g in ("a", None)], schema).coalesce(1).write.parquet(feed)
    expected = spark.createDataFrame([(None, "k"), (None, "x"), ("a", "k")], "g string, field string")
    drift = stream_schema_drift(spark.readStream.schema(schema).parquet(feed), expected, "ts", "j", ["g"])
    got = run_to_table(drift, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert {(r["g"], r["field"], r["drift"]) for r in got} == {("a", "x", "new")}


def test_stream_windows_equal_batch_and_restart(spark, tmp_path):
    from datetime import datetime, timedelta

    feed, schema = str(tmp_path / "feed"), "ts timestamp_ntz, g string, j string"

    def write(days):
        rows = [(datetime(2024, 1, 4) + timedelta(days=d), "g", '{"k": 1}') for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)

    def run():
        stream = spark.readStream.schema(schema).parquet(feed)
        counts = stream_field_inventory(stream, "ts", "j", ["g"], "7 days", "1 day")
        got = run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "state")).collect()
        return sorted((r["window_start"].day, r["n"]) for r in got)

    write([0, 1, 6, 8.5])
    assert run() == [(4, 3)]  # the second window is open
    write([2, 9, 16])  # day 2 is too late
    assert run() == [(4, 3), (11, 2)]


def test_only_touched_buckets_are_written(spark, base):
    from tablechange.sources.publish import bucket_of, republish

    df = spark.range(200).withColumn("v", F.lit("a"))
    first = publish(df, base, "t", keys=["id"], buckets=8)
    assert ids(read_dataset(spark, base, "t")) == list(range(200)) and len(first.parts) == 8
    batch = spark.createDataFrame([(5, "new", "upsert", 1), (7, "x", "delete", 1)], "id int, v string, op string, n int")
    apply_batch(base, "t", ["id"], ["n"])(batch, 0)
    now = current_version(spark, base, "t")
    touched = {r[0] for r in spark.createDataFrame([(5,), (7,)], "id long").select(bucket_of(["id"], 8)).collect()}
    assert {int(b) for b in now.parts if now.parts[b] != first.parts[b]} == touched
    got = {r["id"]: r["v"] for r in read_dataset(spark, base, "t").collect()}
    assert got == {i: "new" if i == 5 else "a" for i in range(200) if i != 7}
    # a bucket may become empty, and the dataset as a whole
    everything = republish(read_dataset(spark, base, "t").limit(0), base, "t", list(range(8)))
    assert everything.parts == {} and read_dataset(spark, base, "t").columns == ["id", "v"]
    assert read_dataset(spark, base, "t").count() == 0
    rename_dataset(spark, base, "t", "u")
    publish(spark.range(3), base, "u", keys=["id"], buckets=2)
    assert ids(read_dataset(spark, base, "u")) == [0, 1, 2]
    with pytest.raises(ValueError):
        publish(spark.range(3), base, "u", buckets=2)


@pytest.mark.parametrize("few", [10_000, 0])
def test_drift_with_and_without_salt(spark, tmp_path, monkeypatch, few):
    from datetime import datetime, timedelta

    import tablechange.streaming.changes as changes

    monkeypatch.setattr(changes, "_FEW_GROUPS", few)
    feed, schema = str(tmp_path / "feed"), "ts timestamp_ntz, g string, j string"
    texts = ['{"a": 1}', '{"a": 1, "b": 2}', "{}", None, "no json"]
    rows = [(datetime(2024, 1, 4) + timedelta(days=i % 20, seconds=i), "gh"[i % 2], texts[i % 5]) for i in range(200)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(feed)
    expected = spark.createDataFrame([("g", "a")], "g string, field string")
    drift = changes.stream_schema_drift(spark.readStream.schema(schema).parquet(feed), expected, "ts", "j", ["g"])
    got = {(r["window_start"].day, r["g"], r["field"], r["drift"]): r["n"] for r in run_to_table(drift, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    want = {}
    for ts, g, j in rows:
        start = 4 + (ts - datetime(2024, 1, 4)).days // 7 * 7
        have = {None: set(), "{}": set(), "no json": set(), texts[0]: {"a"}, texts[1]: {"a", "b"}}[j]
        known = {"a"} if g == "g" else set()
        if start < 18:  # the third window is open
            for f, kind in [(f, "new") for f in have - known] + [(f, "missing") for f in known - have]:
                want[(start, g, f, kind)] = want.get((start, g, f, kind), 0) + 1
    assert got == want
