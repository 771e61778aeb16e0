"""Everything that depends on something, directly or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablechange.session import discard, materialize


_COMPACT = 25  # rounds after which the nodes seen become one table


def impact_closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: the seeds at depth 0 and all nodes reached over ``(src, dst)`` edges,
    each at its least depth. Cycles end, because only nodes not seen before go on.

    One round per depth. The nodes of a round are written to the shared folder, and put together
    now and then, so the plan does not grow with the rounds. Targets are made distinct before nodes seen earlier are
    removed; a node with very many edges is split by adaptive execution, as the join is an
    inner one.
    """
    # read in every round, so its sources are read once
    links = materialize(edges.select(F.col("src"), F.col("dst")), "links")
    frontier = materialize(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, written, depth = frontier, [frontier], 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        reached = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
        written.append(frontier)
        if depth % _COMPACT == 0:
            seen = materialize(seen, "seen")
            for table in written[:-1]:
                discard(table)
            written = [seen, frontier]
    discard(links)
    return seen
