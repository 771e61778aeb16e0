"""An order in which everything comes after what it depends on, and the cycles that prevent one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablechange.operators.closure import impact_closure
from tablechange.session import discard, materialize


def dependency_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, level, cycle)`` for ``(src, dst)`` edges, where ``dst`` depends on ``src``.

    Nodes that depend on nothing have level 0, all others the length of the longest chain before
    them. Nodes that depend on each other cannot be ordered: they share a level, and ``cycle`` names
    the smallest of them; it is null elsewhere. A node that depends on itself is a cycle of one.
    ``nodes`` adds nodes without edges. Edges with a null end are left out, repeated ones count once.

    One round per level, over the edges that still wait; each round writes what is left. Cycles
    are looked for only among the edges that no round can free.
    """
    links = edges.select(F.col("src"), F.col("dst")).dropna().distinct()
    links = materialize(links, "links")
    loops = links.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    chains, waiting = _peel(links.filter("src != dst"))
    stuck = not waiting.isEmpty()
    found = _cycles(waiting) if stuck else None
    # a loop of a node inside a longer cycle says nothing new
    cycles = loops if found is None else found.union(loops.join(found.select("node"), "node", "left_anti"))
    cycles = materialize(cycles, "cycles")
    if stuck:
        discard(chains)
        chains, waiting = _peel(_contracted(links, cycles))
    discard(waiting)

    every = links.select(F.col("src").alias("node")).union(links.select("dst"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(nodes.columns[0])).dropna())
    named = every.distinct().join(cycles, "node", "left").withColumn("__rep", F.coalesce("cycle", "node"))
    short = _contracted(links, cycles) if stuck else links.filter("src != dst")
    after = short.join(chains, "src").groupBy(F.col("dst").alias("__rep")).agg((F.max("level") + 1).alias("__level"))
    return named.join(after, "__rep", "left").select("node", F.coalesce("__level", F.lit(0)).alias("level"), "cycle")


def _peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, level)`` of the nodes that others depend on, and the edges that lie on cycles or behind them.

    Edges to nodes nobody depends on free nothing and are not carried through the rounds."""
    first = materialize(edges.distinct(), "peel")
    left = materialize(first.join(first.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "waiting")

    def unwaited(nodes: DataFrame, level: int) -> DataFrame:
        free = nodes.distinct().join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
        return materialize(free.withColumn("level", F.lit(level)), "free")

    done = [unwaited(first.select("src"), 0)]
    while not done[-1].isEmpty():
        before, level = left, len(done)
        left = materialize(before.join(done[-1], "src", "left_anti"), "waiting")
        done.append(unwaited(before.join(done[-1], "src").select(F.col("dst").alias("src")), level))
        discard(before)
    chains = materialize(reduce(DataFrame.unionByName, done), "chains")
    for df in (*done, first):
        discard(df)
    return chains, left


def _contracted(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """The edges between cycles and single nodes, every cycle being one node."""
    a, b = (cycles.select(F.col("node").alias(end), F.col("cycle").alias(f"__{end}")) for end in ("src", "dst"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    return both.select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst")).filter("src != dst").distinct()


def _cycles(edges: DataFrame) -> DataFrame:
    """``(node, cycle)``: strongly connected parts of more than one node, each under its smallest node.

    Every node takes the smallest node that leads to it as its colour. What leads back to the node
    that gave the colour, over nodes of that colour, forms one part with it. Such parts leave, and
    edges between colours with them, since no cycle has two colours; then the rest goes on."""
    left, parts = _trimmed(edges), []
    none = edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
    while not left.isEmpty():
        colours = _colours(left)
        a, b = (colours.select(F.col("node").alias(end), F.col("colour").alias(f"__{end}")) for end in ("src", "dst"))
        inside = materialize(left.join(a, "src").join(b, "dst").filter("__src = __dst").select("src", "dst"), "inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colours.filter("node = colour").select("node")
        part = materialize(impact_closure(back, roots).select("node").join(colours, "node").select("node", F.col("colour").alias("cycle")), "parts")
        parts.append(part)
        rest = inside.join(part.select(F.col("node").alias("src")), "src", "left_anti")
        rest = rest.join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        left = _trimmed(rest)
        for df in (colours, inside):
            discard(df)
    found = reduce(DataFrame.unionByName, parts) if parts else none
    several = found.groupBy("cycle").agg(F.count("*").alias("__n")).filter("__n > 1").select("cycle")
    return found.join(several, "cycle", "left_semi").select("node", "cycle")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those that start where none ends or end where none starts, again and again."""
    left = materialize(edges.select("src", "dst"), "core")
    size = left.count()
    while size:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = materialize(kept, "core", replaces=left)
        size, before = kept.count(), size
        left = kept
        if size == before:
            break
    return left


def _colours(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the smallest node that leads to each node, itself included. Only nodes whose colour
    changed in a round pass it on."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    held = materialize(ends.select("node", F.col("node").alias("colour")), "colours")
    moved = held
    while True:
        passed = edges.join(moved.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("__new"))
        better = materialize(held.join(passed, "node").filter("__new < colour").select("node", F.col("__new").alias("colour")), "moved")
        if moved is not held:
            discard(moved)
        if better.isEmpty():
            discard(better)
            return held
        taken = held.join(better.select("node", F.col("colour").alias("__new")), "node", "left")
        held = materialize(taken.select("node", F.coalesce("__new", "colour").alias("colour")), "colours", replaces=held)
        moved = better
