"""Versioned datasets in a folder all executors share.

Layout below ``base``: data lies in ``data/<id>/v=<n>`` and is never changed once written. Each
dataset name has numbered pointer files ``pointers/<name>/<n>.json``; the highest number says
where the current version lies, or that the dataset is dropped. A new version is written beside
the old one, checked, and becomes current by one small file; until then, and after any failure,
readers see the old version. Two writers cannot create the same pointer number.

A dataset may be cut into buckets by a hash of its keys. Then a pointer names one folder per
bucket, and ``republish`` writes only the buckets a set of changes touches; the others stay where
an earlier version put them.

Beside its rows a version may keep *marks*, a table by the same keys that readers do not see, such as
the order of the last change of each key. The pointer names both, so they become current together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field as dc_field, replace
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablechange.functions.render import field


class PublishError(RuntimeError):
    """A version was not published; the version before is still current."""


@dataclass
class Pointer:
    number: int
    location: str | None
    version: int
    dropped: bool = False
    tags: dict = dc_field(default_factory=dict)
    schema: str | None = None
    keys: list[str] = dc_field(default_factory=list)
    buckets: int = 0
    parts: dict[str, str] = dc_field(default_factory=dict)
    marks: dict = dc_field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def _read_file(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointer_dir(base: str, name: str) -> str:
    return f"{base}/pointers/{quote(name, safe='')}"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, p, _ = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _write_pointer(spark: SparkSession, base: str, name: str, pointer: Pointer) -> None:
    folder = _pointer_dir(base, name)
    fs, final, jvm = _fs(spark, f"{folder}/{pointer.number:010d}.json")
    temp = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    try:
        out.write(bytearray(json.dumps(asdict(pointer)).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        raise PublishError(f"{name}: another writer published version {pointer.number}")


def last_pointer(spark: SparkSession, base: str, name: str) -> Pointer | None:
    numbers = _numbers(spark, _pointer_dir(base, name))
    if not numbers:
        return None
    return Pointer(**json.loads(_read_file(spark, f"{_pointer_dir(base, name)}/{numbers[-1]:010d}.json")))


def current_version(spark: SparkSession, base: str, name: str) -> Pointer | None:
    """The current pointer, or None for a dataset never created or dropped."""
    pointer = last_pointer(spark, base, name)
    return None if pointer is None or pointer.dropped else pointer


def _read(spark: SparkSession, pointer: Pointer, only: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(pointer.schema))
    if not pointer.buckets:
        return spark.read.schema(schema).parquet(pointer.location)
    wanted = pointer.parts if only is None else {str(b): pointer.parts[str(b)] for b in only if str(b) in pointer.parts}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(wanted.values()))


def read_dataset(spark: SparkSession, base: str, name: str) -> DataFrame:
    pointer = current_version(spark, base, name)
    if pointer is None:
        raise LookupError(f"no dataset {name}")
    return _read(spark, pointer)


def read_buckets(spark: SparkSession, base: str, name: str, buckets: list[int]) -> DataFrame:
    """Only the rows of some buckets."""
    return _read(spark, current_version(spark, base, name), buckets)


def read_marks(spark: SparkSession, pointer: Pointer, only: list[int] | None = None) -> DataFrame | None:
    """The marks kept with a version, or those of some buckets; None if it has none."""
    return _read(spark, Pointer(**pointer.marks), only) if pointer.marks else None


def same_buckets(pointer: Pointer) -> bool:
    """Whether the marks of a version are cut into the same buckets as its rows."""
    return bool(pointer.marks) and (pointer.marks["keys"], pointer.marks["buckets"]) == (pointer.keys, pointer.buckets)


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row. Key columns must have the types of the dataset."""
    return F.pmod(F.xxhash64(*[field(k) for k in keys]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, pointer: Pointer) -> None:
    """Write the rows at the pointer's location; of a bucketed dataset only the buckets in ``df``."""
    if not pointer.buckets:
        df.write.mode("errorifexists").parquet(pointer.location)
        return
    rows = df.withColumn("__bucket", bucket_of(pointer.keys, pointer.buckets)).repartition("__bucket")
    rows.write.mode("errorifexists").partitionBy("__bucket").parquet(pointer.location)
    fs, p, _ = _fs(df.sparkSession, pointer.location)
    for status in fs.listStatus(p):
        folder = status.getPath().getName()
        if folder.startswith("__bucket="):
            pointer.parts[folder.removeprefix("__bucket=")] = f"{pointer.location}/{folder}"


def list_published(spark: SparkSession, base: str) -> list[str]:
    """Names of the datasets that exist, sorted."""
    fs, p, _ = _fs(spark, f"{base}/pointers")
    if not fs.exists(p):
        return []
    names = [unquote(s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted(n for n in names if current_version(spark, base, n))


def publish(
    df: DataFrame,
    base: str,
    name: str,
    validate: Callable[[DataFrame], object] | None = None,
    tags: dict | None = None,
    keys: list[str] | None = None,
    buckets: int = 0,
    marks: DataFrame | None = None,
) -> Pointer:
    """Write ``df`` as the next version, check the written data, make it current.

    ``validate`` gets the written version; it fails by raising or by returning False. Then the
    new files are removed and the version before stays. ``df`` may read the current version.
    With ``keys`` and ``buckets`` the dataset is cut into buckets (about one per gigabyte). Tags and
    marks of the version before stay, unless ``tags`` or ``marks`` give them anew.
    """
    last = last_pointer(df.sparkSession, base, name)
    pointer = _next(base, last)
    live = last is not None and not last.dropped
    pointer.tags, pointer.schema, pointer.keys, pointer.buckets = {**(last.tags if live else {}), **(tags or {})}, df.schema.json(), list(keys or []), buckets
    pointer.marks = last.marks if live else {}
    if buckets and not keys:
        raise ValueError("buckets need keys")
    return _make_current(df, base, name, pointer, validate, marks)


def republish(
    df: DataFrame,
    base: str,
    name: str,
    touched: list[int],
    validate: Callable[[DataFrame], object] | None = None,
    tags: dict | None = None,
    marks: DataFrame | None = None,
) -> Pointer:
    """The next version of a bucketed dataset: ``df`` holds all rows of the ``touched`` buckets,
    every other bucket stays as it is. ``marks`` are those of the touched buckets, or all of them if the
    version before has them in other buckets (see ``same_buckets``)."""
    last = current_version(df.sparkSession, base, name)
    if last is None or not last.buckets:
        raise LookupError(f"no bucketed dataset {name}")
    pointer = _next(base, last)
    pointer.tags, pointer.schema, pointer.keys, pointer.buckets = {**last.tags, **(tags or {})}, last.schema, last.keys, last.buckets
    pointer.parts = {b: path for b, path in last.parts.items() if int(b) not in set(touched)}
    pointer.marks = last.marks
    stay = {b: path for b, path in last.marks["parts"].items() if int(b) not in set(touched)} if same_buckets(last) else {}
    return _make_current(df, base, name, pointer, validate, marks, stay)


def _next(base: str, last: Pointer | None) -> Pointer:
    live = last is not None and not last.dropped
    home = last.location.rsplit("/v=", 1)[0] if live else f"{base}/data/{uuid.uuid4().hex}"
    number, version = (last.number + 1 if last else 1), (last.version + 1 if live else 1)
    # the suffix keeps the files of two writers apart until one of them wins the pointer
    return Pointer(number, f"{home}/v={version}-{uuid.uuid4().hex[:8]}", version)


def _make_current(
    df: DataFrame,
    base: str,
    name: str,
    pointer: Pointer,
    validate: Callable[[DataFrame], object] | None,
    marks: DataFrame | None = None,
    stay: dict[str, str] | None = None,
) -> Pointer:
    spark = df.sparkSession
    beside = Pointer(pointer.number, f"{pointer.location}-marks", pointer.version, keys=pointer.keys, buckets=pointer.buckets, parts=dict(stay or {}))
    try:
        _write(df, pointer)
        if marks is not None:
            beside.schema = marks.schema.json()
            _write(marks, beside)
            pointer.marks = asdict(beside)
        if validate is not None and validate(_read(spark, pointer)) is False:
            raise PublishError(f"{name}: version {pointer.version} failed validation")
        _write_pointer(spark, base, name, pointer)
    except Exception as error:
        for location in (pointer.location, beside.location):
            fs, p, _ = _fs(spark, location)
            fs.delete(p, True)
        if isinstance(error, PublishError):
            raise
        raise PublishError(f"{name}: version {pointer.version} was not published") from error
    return pointer


def create_dataset(spark: SparkSession, base: str, name: str, schema: T.StructType | str) -> Pointer:
    """An empty dataset with a schema."""
    if current_version(spark, base, name):
        raise PublishError(f"dataset {name} exists")
    return publish(spark.createDataFrame([], schema), base, name)


def rename_dataset(spark: SparkSession, base: str, old: str, new: str) -> Pointer:
    """Give a dataset another name; its data stays where it is."""
    pointer = current_version(spark, base, old)
    if pointer is None:
        raise LookupError(f"no dataset {old}")
    there = last_pointer(spark, base, new)
    if there is not None and not there.dropped:
        raise PublishError(f"dataset {new} exists")
    moved = replace(pointer, number=there.number + 1 if there else 1)
    _write_pointer(spark, base, new, moved)
    _write_pointer(spark, base, old, Pointer(pointer.number + 1, None, pointer.version, True))
    return moved


def drop_dataset(spark: SparkSession, base: str, name: str, force_drop: bool = False) -> None:
    """Mark a dataset as dropped. Its files stay for readers that are still on them."""
    if not force_drop:
        raise PublishError(f"dropping {name} needs force_drop")
    pointer = current_version(spark, base, name)
    if pointer is None:
        raise LookupError(f"no dataset {name}")
    _write_pointer(spark, base, name, Pointer(pointer.number + 1, None, pointer.version, True))
