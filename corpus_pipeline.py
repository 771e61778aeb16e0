"""A training-data pipeline over ``documents``: each stage applies one operator to all rows its
predecessor kept. Stages are written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablechange.llm.bpe import bpe_encode
from tablechange.llm.exact_dedup import exact_dedup, normalised
from tablechange.llm.mixing import mix
from tablechange.llm.near_copies import near_copy_classes
from tablechange.llm.queries import TARGETS, labelled_domains, may_learn, vocabulary_path
from tablechange.llm.registry import table
from tablechange.llm.toxicity import score_toxicity, train_toxicity
from tablechange.session import materialize, scratch_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _stage(fn: Stage) -> Stage:
    """Whole texts go to Python in batches of 1,000, unless the session names a size: the 10,000 that Spark takes
    by itself are held several times by each task, which is hundreds of MB for long texts."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, "1000")
        return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels of ids not held out, does not call toxic."""
    model = train_toxicity(docs, may_learn(table(spark, sf_dir, "labels")))
    kept = score_toxicity(docs, model, keep_columns=True).filter("__predicted = 0")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays, with the largest id."""
    kept = exact_dedup(docs, keep="largest").filter("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    return _one_each(docs, kept)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 4/5 over five-word shingles one stays, with the smallest
    id; of several texts with that id the one with the smallest hash."""
    found = near_copy_classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    owners = found.groupBy("class").agg(F.min("node").alias("node"))
    return _one_each(docs, found.join(owners, ["class", "node"]).select("doc_id", F.col("node").alias("sha")), _node)


@_stage
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents resampled so that the languages' expected shares of tokens match the targets."""
    return mix(docs, labelled_domains(spark, sf_dir), TARGETS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text they decode to."""
    found = bpe_encode(docs, vocabulary_path(), decoded_col="decoded", keep=["doc_id"])
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _node(text: Column) -> Column:
    return F.xxhash64(normalised(text))


def _one_each(docs: DataFrame, owners: DataFrame, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """One row for each id and text hash of ``owners``, null ids included. The owners are written, so that a
    small set is broadcast by its measured size; only rows that repeat id and text are shuffled to choose one."""
    owners = materialize(owners.groupBy(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).agg(F.count("*").alias("__rows")), "owners")
    held = docs.withColumn("__text_sha", digest(F.col("text")))
    found = held.join(owners, held["doc_id"].eqNullSafe(owners["__id"]) & (held["__text_sha"] == owners["__sha"]))
    many = found.filter("__rows > 1").dropDuplicates(["__id", "__sha"]) if not owners.filter("__rows > 1").isEmpty() else None
    one = found.filter("__rows = 1")
    return (one if many is None else one.union(many)).select(*docs.columns)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_languages),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
