"""Named queries and functions that may build on each other."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablechange.functions.render import quote_name
from tablechange.functions.text import VARIABLE


def fill_variables(sql: str, variables: dict[str, str]) -> str:
    """``interpolate`` for one text on the driver."""
    return re.sub(VARIABLE, lambda m: variables.get(m.group(1), m.group(0)), sql)


def _is_missing_relation(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("TABLE_OR_VIEW_NOT_FOUND")


def build_models(
    spark: SparkSession,
    models: dict[str, str],
    materialize: str | None = None,
    variables: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Create a temporary view per query, in whatever order they need each other.

    A query that names a view not yet there waits for the next round; any other error is raised
    at once. When a round makes no progress the last error is raised. With ``materialize`` (a
    folder) each model is written as Parquet and the view reads that.
    """
    for name in models:
        spark.catalog.dropTempView(name)  # a view of an earlier build must not stand in
    pending, built, last = dict(models), {}, None
    while pending:
        waiting = {}
        for name, sql in pending.items():
            try:
                df = spark.sql(fill_variables(sql, variables or {}))
            except AnalysisException as error:
                if not _is_missing_relation(error):
                    raise
                waiting[name], last = sql, error
                continue
            if materialize:
                path = f"{materialize}/{name}"
                df.write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
            df.createOrReplaceTempView(name)
            built[name] = df
        if len(waiting) == len(pending):
            raise last
        pending = waiting
    return built


def build_functions(spark: SparkSession, functions: dict[str, str]) -> None:
    """Create or replace temporary SQL functions from full definitions, e.g.
    ``{"net": "(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)"}``. Functions may use each
    other, in any order."""
    pending, last = dict(functions), None
    while pending:
        waiting = {}
        for name, body in pending.items():
            try:
                spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quote_name(name)}{body}")
            except AnalysisException as error:
                if error.getCondition() not in ("UNRESOLVED_ROUTINE", "ROUTINE_NOT_FOUND"):
                    raise
                waiting[name], last = body, error
        if len(waiting) == len(pending):
            raise last
        pending = waiting
