"""Looking at data: ad-hoc SQL, previews, listings, name search."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tablechange.functions.render import field, render_text


class RunInfo:
    """Columns at once; row count and time once the DataFrame has been read."""

    def __init__(self, columns: list[str], observation: Observation):
        self.columns = columns
        self._observation = observation
        self._start = time.perf_counter()
        self._rows: int | None = None
        self._seconds: float | None = None

    @property
    def rows(self) -> int:
        """Rows of the first action on the result; waits for it. No second pass is run."""
        if self._rows is None:
            self._rows = self._observation.get["rows"]
            self._seconds = time.perf_counter() - self._start
        return self._rows

    @property
    def seconds(self) -> float:
        _ = self.rows
        return self._seconds


def run_sql(spark: SparkSession, sql: str, args: dict | list | None = None) -> tuple[DataFrame, RunInfo]:
    """Any SQL Spark accepts, as a lazy DataFrame, with a counter riding on its first action."""
    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), RunInfo(df.columns, seen)


def preview(df: DataFrame, order: list[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``order``, every cell as text."""
    return render_text(df.orderBy(*order).limit(n))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def describe_columns(df: DataFrame, counts: bool = False) -> DataFrame:
    """``(ordinal, column, type)``; with ``counts`` also ``non_null``, counted in one pass."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    listing = df.sparkSession.createDataFrame(rows, "ordinal int, `column` string, type string")
    if counts:
        filled = df.agg(*[F.count(field(c)).alias(c) for c in df.columns])
        filled = filled.unpivot([], [field(c) for c in df.columns], "column", "non_null")
        listing = listing.join(filled, "column").select("ordinal", "column", "type", "non_null")
    return listing.orderBy("ordinal")


def list_datasets(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``(kind, namespace, name)`` of tables and views, sorted."""
    rows = [
        ("view" if t.isTemporary or t.tableType == "VIEW" else "table", ".".join(t.namespace or []), t.name)
        for t in spark.catalog.listTables(database)
    ]
    return spark.createDataFrame(rows, "kind string, namespace string, name string").orderBy("kind", "namespace", "name")


def text_widths(df: DataFrame, cap: int = 30) -> DataFrame:
    """``(column, width)``: the longest rendered cell or header in bytes, plus two, at most ``cap``."""
    text = render_text(df)
    longest = text.agg(*[F.max(F.octet_length(field(c))).alias(c) for c in text.columns])
    tall = longest.unpivot([], [field(c) for c in text.columns], "column", "longest")
    width = F.least(F.greatest(F.octet_length("column"), F.coalesce("longest", F.lit(0))) + 2, F.lit(cap))
    return tall.select("column", width.cast("int").alias("width"))


def vocabulary(terms: list[DataFrame]) -> DataFrame:
    """Distinct terms of one-column DataFrames; duplicates go before the shuffle."""
    out = None
    for df in terms:
        one = df.select(F.col(df.columns[0]).cast("string").alias("term"))
        out = one if out is None else out.unionByName(one)
    return out.filter("term IS NOT NULL").distinct()


def prefix_lookup(vocab: DataFrame, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``(prefix, term)`` for each term that begins with a prefix, ignoring case. Terms are joined
    by their beginnings of the lengths that occur among the prefixes, so it is an equi-join."""
    wanted = prefixes.select(F.col(prefix).alias("prefix")).filter("prefix <> ''").distinct()
    wanted = wanted.withColumn("low", F.lower("prefix"))
    # one small row per distinct length
    lengths = sorted(r[0] for r in wanted.select(F.length("low")).distinct().collect())
    low = F.lower("term")
    starts = F.array_compact(F.array(*[F.when(F.length(low) >= n, F.substring(low, 1, n)) for n in lengths]))
    return vocab.select("term", F.explode(starts).alias("low")).join(wanted, "low").select("prefix", "term")
