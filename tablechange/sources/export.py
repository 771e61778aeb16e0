"""CSV export and the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablechange.functions.render import render_text
from tablechange.functions.text import fingerprint

RUN_LOG = "at timestamp_ntz, seconds double, query string"


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write rendered cells as CSV with a header: null as ``NULL``, empty text as nothing, quotes
    doubled. Every part file has the header; ``single_file`` is for results of one task's size."""
    text = render_text(df)
    (text.coalesce(1) if single_file else text).write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        nullValue="NULL",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def append_run_log(spark: SparkSession, path: str, query: str, seconds: float, at: datetime | None = None) -> None:
    """Append one successful query to a Parquet log."""
    row = [(at or datetime.now().replace(tzinfo=None), float(seconds), query)]
    spark.createDataFrame(row, RUN_LOG).coalesce(1).write.mode("append").parquet(path)


def run_stats(log: DataFrame, query: str = "query", seconds: str = "seconds") -> DataFrame:
    """Runs, mean and longest time per query; texts that differ in case or whitespace only count
    as one. The digest stands for the text in the shuffle."""
    grouped = log.groupBy(fingerprint(query).alias("fingerprint"))
    return grouped.agg(F.count("*").alias("runs"), F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("max_seconds"))
