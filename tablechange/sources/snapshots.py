"""Keyed snapshots, and saving them for a later comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablechange.functions.render import field


class SnapshotKeyError(ValueError):
    """A snapshot has a missing or repeated key."""


def qualified_name(namespace: Column, name: Column, default: str = "main") -> Column:
    """The bare name in the default namespace, else ``namespace.name``."""
    return F.when(namespace == default, name).otherwise(F.concat_ws(".", namespace, name))


def keyed_snapshot(
    df: DataFrame, keys: list[str], attrs: list[str], scope: str | None = None, check: bool = True, missing: str | None = None
) -> DataFrame:
    """The keys, the attributes and the scope of ``df``, one row per key.

    With ``check`` a missing or repeated key raises: one grouping by the keys alone, which reads
    no attribute column. ``missing`` stands in for null text attributes.
    """
    if check:
        bad = (
            df.groupBy(*[field(k) for k in keys])
            .agg(F.count("*").alias("__n"))
            .filter((F.col("__n") > 1) | F.greatest(*[field(k).isNull() for k in keys], F.lit(False)))
            .take(1)
        )
        if bad:
            raise SnapshotKeyError(f"missing or repeated key {[bad[0][k] for k in keys]} ({bad[0]['__n']} rows)")
    cols = [field(k) for k in keys]
    for a in attrs:
        fill = missing is not None and df.schema[a].dataType.typeName() == "string"
        cols.append(F.coalesce(field(a), F.lit(missing)).alias(a) if fill else field(a))
    if scope and scope not in [*keys, *attrs]:
        cols.append(field(scope))
    return df.select(cols)


def save_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write one version of a snapshot; an existing version is not overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/v={version}")


def load_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Read one version; the schema comes from the files of that version alone."""
    return spark.read.parquet(f"{path}/v={version}")
