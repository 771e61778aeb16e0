"""The same checks over streams."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablechange.functions.render import field
from tablechange.session import discard, materialize
from tablechange.sources.inventory import fields_of
from tablechange.sources.publish import bucket_of, current_version, publish, read_buckets, read_dataset, read_marks, republish, same_buckets


_FEW_GROUPS = 10_000
_SALTS = 16
_ORDER = "__order"


def _windowed(stream: DataFrame, ts: str, window: str, watermark: str) -> tuple[DataFrame, Column]:
    """Event time as a zoned timestamp, which watermarks need."""
    timed = stream.withColumn(ts, field(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed, F.window(field(ts), window)


def stream_field_inventory(
    stream: DataFrame, ts: str, json_col: str, by: list[str], window: str = "7 days", watermark: str = "1 day"
) -> DataFrame:
    """Fields per tumbling window and group: ``(window_start, by..., field, json_type, n)``. Rows
    later than the watermark are dropped. State holds one count per window, group and field."""
    timed, span = _windowed(stream, ts, window, watermark)
    rows = fields_of(timed, json_col, [field(ts), *[field(b) for b in by]])
    counts = rows.groupBy(span.alias("w"), *by, "field", "json_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "field", "json_type", "n")


def stream_schema_drift(
    stream: DataFrame,
    expected: DataFrame,
    ts: str,
    json_col: str,
    by: list[str],
    window: str = "7 days",
    watermark: str = "1 day",
) -> DataFrame:
    """New and missing fields per window and group against ``expected`` (``by..., field``):
    ``(window_start, by..., field, drift, n)``.

    Each row is compared with the expected fields of its group, which come in by a stream-static
    join as one array per group (bounded by the number of fields). A field outside it is ``new``;
    an expected field the row lacks is ``missing``, and ``n`` counts such rows.
    """
    # written first: its size is known, so a small one is broadcast. Streams with state are not
    # re-planned at run time, so with very many groups a busy one is split by a salt
    wanted = materialize(expected.groupBy(*by).agg(F.collect_set("field").alias("__wanted")), "expected")
    salts = 1 if wanted.count() <= _FEW_GROUPS else _SALTS
    wanted = wanted.withColumn("__salt", F.explode(F.array([F.lit(i) for i in range(salts)])))
    timed, span = _windowed(stream, ts, window, watermark)
    present = F.map_keys(F.from_json(field(json_col), "map<string,variant>"))
    empty = F.array().cast("array<string>")
    rows = timed.select(field(ts), *[field(b) for b in by], F.coalesce(present, empty).alias("__have"))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(field(ts)), F.lit(salts)).cast("int"))
    # a null group is a group
    named = wanted.select(*[field(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("__salt").alias("__of"), "__wanted")
    alike = reduce(lambda x, y: x & y, [field(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)], F.col("__salt") == F.col("__of"))
    rows = rows.join(named, alike, "left").withColumn("__wanted", F.coalesce("__wanted", empty))

    def tagged(names: Column, drift: str) -> Column:
        return F.transform(names, lambda f: F.struct(F.lit(drift).alias("drift"), f.alias("field")))

    found = F.concat(tagged(F.array_except("__have", "__wanted"), "new"), tagged(F.array_except("__wanted", "__have"), "missing"))
    flat = rows.select(field(ts), *[field(b) for b in by], F.explode(found).alias("f"))
    counts = flat.groupBy(span.alias("w"), *by, F.col("f.field").alias("field"), F.col("f.drift").alias("drift")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "field", "drift", "n")


class StreamName:
    """The name of a stream, which is known once it has started."""

    def __init__(self):
        self._known, self._name = threading.Event(), ""

    def set(self, name: str) -> None:
        self._name = name
        self._known.set()

    def __str__(self) -> str:
        self._known.wait()
        return self._name


def apply_batch(
    base: str, name: str, keys: list[str], order: list[str], op: str = "op", stream: str | StreamName = ""
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies a batch of row changes to a published dataset.

    A batch has the dataset's columns, an ``op`` column (``upsert`` or ``delete``) and the columns
    of ``order``; per key only the latest change counts. Of equal orders the one that comes last does.

    That holds over batches and streams too: with each version the order of the last change of every
    key is kept, also of deleted ones, and a change that is older than that is dropped, however late it
    comes. A row that no stream has changed yet is as old as its own columns of ``order`` say,
    where the dataset has them; else any change is newer. So the rows are those of one run over all
    changes, in whatever batches they arrive. The orders of deleted keys stay until the dataset is
    dropped.

    The last batch id of each stream is stored with the version and kept by later ones, so a batch
    delivered again changes nothing, and batches of several streams into one dataset do not shadow
    each other: ``stream`` tells them apart. Of a dataset published in buckets by the same
    keys only the buckets with changes are read and written, the orders included.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = current_version(spark, base, name)
        if now is None:
            raise LookupError(f"no dataset {name}")
        mark = f"batch of {stream}"
        if now.tags.get(mark, -1) >= batch_id:
            return
        schema = read_dataset(spark, base, name).schema
        types = {f.name: f.dataType for f in schema}
        batch = batch.select([field(c).cast(types[c]).alias(c) if c in types else field(c) for c in batch.columns])
        # the latest change per key as a partial aggregate, so a key changed very often is no hot spot
        body = F.struct(*[field(c) for c in batch.columns])
        latest = batch.groupBy(*[field(k) for k in keys]).agg(F.max_by(body, F.struct(*[field(o) for o in order])).alias("b"))
        latest = materialize(latest.select("b.*"), "latest")
        bucketed = now.buckets > 0 and now.keys == keys
        touched = None
        if bucketed:
            # at most one number per bucket
            found = latest.select(bucket_of(keys, now.buckets).alias("b")).distinct()
            touched = sorted(r["b"] for r in found.collect())
            current = read_buckets(spark, base, name, touched)
        else:
            current = read_dataset(spark, base, name)
        named = [field(k) for k in keys]
        marks = read_marks(spark, now, touched if bucketed and same_buckets(now) else None)
        if marks is not None:
            kinds = {f.name: f.dataType for f in marks.schema[_ORDER].dataType}
            latest_order = F.struct(*[field(o).cast(kinds[o]).alias(o) for o in order])
        else:
            latest_order = F.struct(*[field(o) for o in order])
        dated = latest.withColumn(_ORDER, latest_order)
        if marks is None:
            marks = spark.createDataFrame([], dated.select(*named, _ORDER).schema)
        met = marks.join(latest.select(*named), keys, "left_semi")
        if set(order) <= set(types):
            own = F.struct(*[field(o) for o in order]).cast(dated.schema[_ORDER].dataType).alias(_ORDER)
            rows = current.join(latest.select(*named), keys, "left_semi").select(*named, own)
            met = met.unionByName(rows).groupBy(*named).agg(F.max(_ORDER).alias(_ORDER))
        known = met.withColumnRenamed(_ORDER, "__known")
        newer = dated.join(known, keys, "left").filter(F.col("__known").isNull() | (F.col(_ORDER) >= F.col("__known"))).drop("__known")
        newer = materialize(newer, "newer")
        upserts = newer.filter(F.col(op) == "upsert").select([field(c) for c in current.columns])
        result = current.join(newer.select(*named), keys, "left_anti").unionByName(upserts)
        orders = marks.join(newer.select(*named), keys, "left_anti").unionByName(newer.select(*named, _ORDER))
        if bucketed:
            republish(result, base, name, touched, tags={mark: batch_id}, marks=orders)
        else:
            publish(result, base, name, tags={mark: batch_id}, keys=now.keys, buckets=now.buckets, marks=orders)
        discard(latest)
        discard(newer)

    return run


def stream_apply_changes(
    stream: DataFrame, base: str, name: str, keys: list[str], order: list[str], checkpoint: str, op: str = "op"
):
    """Run a stream of row changes into a published dataset until its input is used up. The stream is
    known by the id that its checkpoint folder keeps."""
    own = StreamName()
    writer = stream.writeStream.foreachBatch(apply_batch(base, name, keys, order, op, own))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    own.set(query.id)
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode result into Parquet until its input is used up, and read it."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
