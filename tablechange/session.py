"""Session settings and the shared folder for data that must outlive a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "tablechange", cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variable.substitute", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="tablechange-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_root(spark)


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage like a checkpoint does, survives lost executors, and gives the next
    plan real sizes, so that Catalyst broadcasts only what is measured as small. ``replaces`` is
    an earlier result of this function that nothing needs any more; its files are removed, so a
    loop holds one table and not one per round.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if replaces is not None:
        discard(replaces)
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized DataFrame; any other DataFrame is left alone."""
    path = getattr(df, "_scratch_path", None)
    if path is not None:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
