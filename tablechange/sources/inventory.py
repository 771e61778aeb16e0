"""Which columns and fields exist: of datasets, of files, of semi-structured columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablechange.functions.render import field
from tablechange.session import materialize

INVENTORY = "dataset string, ordinal int, `column` string, type string, nullable boolean"


def _columns(dataset: str, schema: T.StructType) -> list[tuple]:
    return [(dataset, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields, start=1)]


def schema_inventory(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """``(dataset, ordinal, column, type, nullable)`` of Parquet datasets; reads one footer each."""
    rows = [r for name, path in datasets.items() for r in _columns(name, spark.read.parquet(path).schema)]
    return spark.createDataFrame(rows, INVENTORY)


def frame_inventory(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """The same for DataFrames; runs nothing."""
    return spark.createDataFrame([r for name, df in frames.items() for r in _columns(name, df.schema)], INVENTORY)


def catalog_inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The same for the tables and views of a catalog database, named bare in the default
    database and ``database.table`` in others."""
    database = database or spark.catalog.currentDatabase()
    rows = []
    for t in spark.catalog.listTables(database):
        full = t.name if t.isTemporary or database == "default" else f"{database}.{t.name}"
        rows += _columns(full, spark.table(t.name if t.isTemporary else f"`{database}`.`{t.name}`").schema)
    return spark.createDataFrame(rows, INVENTORY)


def with_row_counts(inventory: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Add ``num_rows``, counted on the executors in one job; no column is read for it. The plan has a
    branch per dataset; for many Parquet datasets see ``with_file_row_counts``."""
    counts = None
    for name, df in datasets.items():
        one = df.agg(F.count("*").alias("num_rows")).select(F.lit(name).alias("dataset"), "num_rows")
        counts = one if counts is None else counts.unionByName(one)
    return inventory.join(counts, "dataset", "left")


def with_file_row_counts(inventory: DataFrame, root: str, dataset: str, glob: str = "*.parquet") -> DataFrame:
    """Add ``num_rows`` of all Parquet datasets below a folder by one grouped read, however many there
    are. ``dataset`` is a pattern whose first group takes the dataset's name from the path of a file."""
    spark = inventory.sparkSession
    # no column is read, so files of any schema can be read together
    rows = spark.read.schema(T.StructType()).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(root)
    counts = rows.groupBy(F.regexp_extract(_file_read(), dataset, 1).alias("dataset")).agg(F.count("*").alias("num_rows"))
    return inventory.join(counts, "dataset", "left")


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """``(path, length)`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")


def _file_read() -> Column:
    """The file of a row. The reader shows it in URI form, where + stands for itself."""
    return _file_uri(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))


def _readable(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """The files as few tables: those whose columns have the same types are read as one, with the columns of
    all of them. Files that don't fit together are halved until they do."""
    try:
        # a folder such as p=1 is part of the path here, not a column
        found = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*files)
        return [found]
    except Exception as error:
        if "MERGE_SCHEMA" not in str(error) or len(files) == 1:
            raise
    half = len(files) // 2
    return _readable(spark, files[:half]) + _readable(spark, files[half:])


def _file_uri(path: Column) -> Column:
    return F.when(path.rlike("^/"), F.concat(F.lit("file://"), path)).otherwise(F.regexp_replace(path, "^file:/+", "file:///"))


FILE_INVENTORY = "file string, ordinal int, `column` string, type string, num_rows long, n_values long, missing boolean"


def file_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(file, ordinal, column, type, num_rows, n_values, missing)`` of Parquet files, read by Spark.

    One pass over the files counts rows and values per file and column, with the reader's hidden file path as
    the group; counts are added up in each task. A column that other files have and this one does
    not is shown with ``missing``, without ordinal and with the type it has elsewhere. Files with values in
    the same columns are taken as alike: the names, order and types of one of them are read, so
    the driver looks at one footer per variant. A column without any value counts as missing unless
    that one has it. A file without rows has one row with ``num_rows`` 0 and no column. Files whose
    columns have different types are read as separate tables (see ``_readable``).
    """
    spark = paths.sparkSession
    listed = materialize(paths.select(_file_uri(field(path)).alias("file")).distinct(), "files")
    # the list of files is on the driver anyway, as the reader's file index
    files = sorted(r["file"] for r in listed.collect())
    if not files:
        return spark.createDataFrame([], FILE_INVENTORY)
    parts = [_counted_files(spark, df) for df in _readable(spark, files)]
    found = reduce(DataFrame.unionByName, parts)
    # columns of the other tables, each with one of its types
    known = found.groupBy("column").agg(F.min("type").alias("type"))
    seen = found.select("file", "num_rows").distinct()
    absent = seen.join(known).join(found.select("file", "column"), ["file", "column"], "left_anti") if len(parts) > 1 else None
    out = found if absent is None else found.unionByName(absent.select("file", F.lit(None).cast("int").alias("ordinal"), "column", "type", "num_rows", F.lit(0).cast("long").alias("n_values"), F.lit(True).alias("missing")))
    empty = listed.join(seen, "file", "left_anti").withColumn("num_rows", F.lit(0).cast("long"))
    return out.unionByName(empty, allowMissingColumns=True).select("file", "ordinal", "column", "type", "num_rows", "n_values", "missing")


def _counted_files(spark: SparkSession, df: DataFrame) -> DataFrame:
    names = df.columns
    counts = df.groupBy(_file_read().alias("file")).agg(F.count("*").alias("__n"), *[F.count(field(c)).alias(f"__{i}") for i, c in enumerate(names)])
    filled = F.concat_ws(",", *[F.when(F.col(f"__{i}") > 0, F.lit(str(i))) for i in range(len(names))])
    counts = materialize(counts.withColumn("__variant", filled), "counts")
    # one file of each variant, and the place and type of each column in it
    shown = counts.groupBy("__variant").agg(F.min("file").alias("file")).collect()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    variants = []
    for r in shown:
        own = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(spark.read.parquet(r["file"]).schema.fields, start=1)}
        variants += [(r["__variant"], c, *own.get(c, (None, types[c]))) for c in names]
    variants = spark.createDataFrame(variants, "__variant string, column string, ordinal int, type string")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("n_values")) for i, c in enumerate(names)]))
    rows = counts.select("file", F.col("__n").alias("num_rows"), "__variant", each.alias("c")).select("file", "num_rows", "__variant", "c.*")
    found = rows.join(variants, ["__variant", "column"])
    return found.select("file", "ordinal", "column", "type", "num_rows", "n_values", F.col("ordinal").isNull().alias("missing"))


_STORED = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "boolean": "bool", "date": "date32", "timestamp_ntz": "timestamp"}


def file_schema_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(file, ordinal, column, type, num_rows)`` of each Parquet file, with the names of stored types. Types
    are those of the file, so a dataset whose files drifted apart shows it."""
    name = F.regexp_replace("type", "^array<", "list<")
    for spark_name, stored in _STORED.items():
        name = F.when(F.col("type") == spark_name, stored).otherwise(name)
    return file_inventory(paths, path).filter("NOT missing").select("file", "ordinal", "column", name.alias("type"), "num_rows")


def json_type(value: Column) -> Column:
    """The JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null")
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
    )


def fields_of(df: DataFrame, json_col: str, keep: list[str | Column]) -> DataFrame:
    """One row per field of each JSON object: the kept columns, ``field`` and ``json_type``.
    Text that is no JSON object has no fields."""
    parsed = F.from_json(field(json_col), "map<string,variant>")
    return df.select(*keep, F.explode(parsed).alias("field", "__v")).withColumn("json_type", json_type(F.col("__v"))).drop("__v")


def field_inventory(df: DataFrame, json_col: str, by: list[str]) -> DataFrame:
    """``(by..., field, json_type, n, n_null)``: which fields occur how often per group. Counts
    are added up before the shuffle, so a group with most of the rows costs no more than others."""
    rows = fields_of(df, json_col, [field(b) for b in by])
    return rows.groupBy(*by, "field", "json_type").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("json_type") == "null", 1)).alias("n_null")
    )
