"""Snapshots stored with a hash tree, and their diff by descending where the trees differ.

A leaf of the tree is a range of the hash of the keys; the ranges depend on the number of leaves alone, so
a row has the same leaf in every version. Rows are stored in the order of their leaves, in small
Parquet pages, so that a reader skips the pages of other leaves. A leaf's digest combines the 128-bit
digests of its rows, an inner node's those of its ``2^FAN_BITS`` children; each level is a small table.

A diff compares the roots, then only the children of nodes that differ, and reads the rows of the
leaves it ends at. Two versions that differ in few rows are compared by reading few rows, however many
they hold: about the changed rows times the rows of a leaf, instead of all keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablechange.functions.render import field
from tablechange.operators.diff import diff, row_digest
from tablechange.session import discard, materialize

FAN_BITS = 6
LEAF_ROWS = 32
_LEAF = "__leaf"
# Up to so many leaves are named in the filter that the reader skips pages by. Beyond, every page is likely to
# be hit, and the leaves are joined only.
_NAMED_LEAVES = 1_000


@dataclass(frozen=True)
class HashTree:
    """A stored version: ``bits`` of the key's hash name a leaf."""

    path: str
    keys: tuple[str, ...]
    bits: int

    def levels(self) -> list[int]:
        """The bits of each level, from the root on."""
        return sorted({0, *range(self.bits, 0, -FAN_BITS)})

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def nodes(self, spark: SparkSession, bits: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/nodes/bits={bits}").select("node", "n", "a", "b")


def _leaf(keys: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[field(k) for k in keys]), 64 - bits) if bits else F.lit(0).cast("long")


def save_hashed_snapshot(
    df: DataFrame, path: str, version: int, keys: list[str], leaf_rows: int = LEAF_ROWS, like: int | None = None
) -> HashTree:
    """Write one version of a keyed snapshot with its tree; an existing version is not overwritten.

    The number of leaves follows the rows, ``leaf_rows`` for each at most. ``like`` names an earlier version whose
    leaves are taken instead: only trees with the same leaves can be compared. The tree is built from
    the rows as they were written.
    """
    spark = df.sparkSession
    if like is None:
        rows, bits = df.count(), 0
        while rows > leaf_rows << bits:
            bits += 1
    else:
        bits = load_hash_tree(spark, path, like).bits
    tree = HashTree(f"{path}/v={version}", tuple(keys), bits)
    placed = df.withColumn(_LEAF, _leaf(keys, bits)).repartitionByRange(_LEAF).sortWithinPartitions(_LEAF)
    placed.write.mode("errorifexists").option("parquet.page.row.count.limit", max(leaf_rows, 20)).parquet(f"{tree.path}/rows")
    written = tree.rows(spark)
    digest = row_digest(written, [c for c in written.columns if c != _LEAF])
    parts = written.select(F.col(_LEAF).alias("node"), F.lit(1).cast("long").alias("n"), digest.alias("d")).select("node", "n", "d.*")
    above = None
    for level in reversed(tree.levels()):
        node = F.col("node") if above is None else F.shiftright("node", above - level)
        sums = parts.groupBy(node.alias("node")).agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        sums.repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{tree.path}/nodes/bits={level}")
        parts, above = tree.nodes(spark, level), level
    meta = spark.createDataFrame([(list(keys), bits)], "keys array<string>, bits int")
    meta.coalesce(1).write.parquet(f"{tree.path}/tree")  # last: a version without it is not whole
    return tree


def load_hash_tree(spark: SparkSession, path: str, version: int) -> HashTree:
    meta = spark.read.parquet(f"{path}/v={version}/tree").first()
    return HashTree(f"{path}/v={version}", tuple(meta["keys"]), meta["bits"])


def differing_leaves(spark: SparkSession, old: HashTree, new: HashTree) -> DataFrame:
    """``(node)``: the leaves whose rows are not the same in both versions."""
    if (old.keys, old.bits) != (new.keys, new.bits):
        raise ValueError("only trees with the same keys and leaves can be compared; save one like the other")
    found, above = None, 0
    for level in old.levels():
        sides = []
        for tree in (old, new):
            nodes = tree.nodes(spark, level)
            if found is not None:
                # written, so a small set is broadcast and the other nodes of the level are dropped as they are read
                nodes = nodes.join(found.withColumnRenamed("node", "__above"), F.shiftright("node", level - above) == F.col("__above"), "left_semi")
            sides.append(nodes.select("node", F.struct("n", "a", "b").alias("d")))
        both = sides[0].withColumnRenamed("d", "o").join(sides[1], "node", "full_outer")
        found = materialize(both.filter(~F.col("o").eqNullSafe(F.col("d"))).select("node"), "nodes", replaces=found)
        above = level
    return found


def rows_of_leaves(spark: SparkSession, tree: HashTree, leaves: DataFrame) -> DataFrame:
    """The rows of some leaves, without their number. Few leaves are named in the scan's filter."""
    rows = tree.rows(spark)
    some = sorted(r[0] for r in leaves.limit(_NAMED_LEAVES + 1).collect())
    if len(some) > _NAMED_LEAVES:
        return rows.join(leaves.withColumnRenamed("node", _LEAF), _LEAF, "left_semi").drop(_LEAF)
    # one comparison for each: of a list the reader would look at the smallest and largest only
    wanted = [F.col(_LEAF) == x for x in some] or [F.lit(False)]
    while len(wanted) > 1:  # halved, so that the expression stays flat
        wanted = [reduce(or_, wanted[i : i + 2]) for i in range(0, len(wanted), 2)]
    return rows.filter(wanted[0]).drop(_LEAF)


def diff_hashed(
    spark: SparkSession, path: str, old_version: int, new_version: int, attrs: list[str] | None = None, scope: str | None = None
) -> DataFrame:
    """The change set between two stored versions, as ``diff`` gives it, from the rows of differing leaves.

    Rows whose digests are equal are taken for equal; two different leaves have one digest with
    probability 2^-128. Versions with other columns than each other differ in all leaves.
    """
    old, new = (load_hash_tree(spark, path, v) for v in (old_version, new_version))
    leaves = differing_leaves(spark, old, new)
    sides = [materialize(rows_of_leaves(spark, tree, leaves), "side") for tree in (old, new)]
    discard(leaves)
    return diff(*sides, list(old.keys), attrs, scope=scope)
