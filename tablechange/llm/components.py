"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablechange.session import discard, materialize


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over ``(u, v)`` pairs with ``v < u``. The neighbours' minimum is a partial
    aggregate, and the join back has one row per node on one side, so a hub is split by adaptive
    execution."""
    if large:
        both = pairs.union(pairs.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        linked = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges`` (two long columns): the smallest node reached.

    Each round is written to the shared folder and replaces the one before, so lineage and space
    stay bounded and a lost executor costs one round. It ends when a round changes nothing; that
    takes about the logarithm of the longest path. Loops and repeated edges do no harm; nulls are
    left out; no edges give no rows.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    now = materialize(pairs, "edges")
    mark = None
    while True:
        stars = materialize(_stars(now, large=True), "stars")
        discard(now)
        now = materialize(_stars(stars, large=False), "stars")
        discard(stars)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.union(roots)
