"""Row numbers over an order, without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablechange.session import materialize


def number_rows(df: DataFrame, groups: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Number the rows of each group from 1 by ``order``.

    The rows are range-partitioned by group and order together, so a group that holds most of
    the rows is cut into ranges like any other. Each range numbers its own rows; the counts of
    the ranges before it (one small row per range and group) are added.
    """
    by = [*groups, *order]
    ranged = df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy("__range", *groups).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", *groups, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range", *groups).orderBy(*order)
    numbered = ranged.withColumn("__i", F.row_number().over(inside))
    same = [F.col("l.__range") == F.col("r.__range")] + [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    joined = numbered.alias("l").join(offsets.alias("r"), same)
    keep = [F.col(f"l.{c}") for c in df.columns if c != name]
    return joined.select(*keep, (F.col("l.__i") + F.col("r.__before")).cast("long").alias(name))
