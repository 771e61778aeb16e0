"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 4/5.

First links come from SimHash fingerprints, whose BK-trees find the closest copies. Fingerprints
alone miss most pairs at this similarity, so the rest is found by prefixes: under one order of all
shingles, two sets that are similar enough share one of the first ``n - ceil(4 n / 5) + 1`` shingles
of each. The order puts shingles last whose hashes fall in cells that many of all texts hold;
any order is right, it only decides how many candidates there are. Where a shared shingle stands says how much two sets can
have in common from there on; a pair that cannot reach the similarity by that is no candidate. So long
passages that many texts share do not bring these texts together. Every link is confirmed on the
shingles themselves, which are computed again for candidates only instead of being stored for all.

Candidates are not built within texts already linked: each shared shingle first links its texts to
one of them, and only texts still apart are then paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablechange.llm.bpe import _slices
from tablechange.llm.components import components
from tablechange.llm.exact_dedup import normalised
from tablechange.llm.simhash import _pieces, _shingle_hashes, near_links
from tablechange.llm.memory import tidy
from tablechange.session import discard, materialize

WIDTH, LEAST = 5, (4, 5)
CELLS, CELL_BLOCK = 1 << 20, 1 << 12
SLICE_BYTES = 1 << 20


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """``(node, __text)``: a hash of the normalised text, and the text in UTF-8."""
    text = normalised(F.col(text_col))
    return docs.select(F.xxhash64(text).alias("node"), F.encode(text, "UTF-8").alias("__text"))


def _sets(batch: pa.RecordBatch, width: int):
    """The nodes and distinct shingles of a batch of ``_rows``, a bounded amount of text at a time."""
    for start, stop in _slices(batch, 1, SLICE_BYTES):
        texts = batch.column(1)[start:stop]
        # texts without words have one shingle of their own
        yield batch.column(0)[start:stop], [np.unique(np.array(_shingle_hashes(t.as_py(), width) or [0], np.uint64)).view(np.int64) for t in texts]


def shingle_sets(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(node, n, hashes)`` of ``(node, __text)``: the distinct shingles. Words are those of ``simhash_fingerprints``."""

    def run(batches):
        for b in batches:
            for nodes, sets in _sets(b, width):
                yield pa.RecordBatch.from_arrays([nodes, pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "hashes"])

    return rows.mapInArrow(tidy(run), "node long, n int, hashes array<long>")


def _cell(hashes: np.ndarray) -> np.ndarray:
    return hashes & (CELLS - 1)


def shingle_counts(rows: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many texts of ``(node, __text)`` hold a shingle of each of ``CELLS`` cells, over all texts.

    A cell is what the low bits of the hash say. Each partition adds its texts up in one table, whose blocks are
    then added by number, so what is shuffled goes with the partitions and what reaches the driver (8 MB)
    with neither texts nor partitions. Cells are shared by many rare shingles alike; the more texts there are, the
    rarer a passage may be and still stand out.
    """

    def count(batches):
        cells, some = np.zeros(CELLS, np.int64), False
        for b in batches:
            for _, sets in _sets(b, width):
                cells += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
                some = True
        if some:
            blocks = [x.tobytes() for x in cells.reshape(-1, CELL_BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
                more = np.frombuffer(counts.as_py(), np.int64)
                total[block] = total[block] + more if block in total else more
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    found = rows.mapInArrow(tidy(count), schema).repartition("block").mapInArrow(add, schema).toArrow()
    cells = np.zeros(CELLS, np.int64)
    for block, counts in zip(found.column(0).to_pylist(), found.column(1)):
        cells[block * CELL_BLOCK : (block + 1) * CELL_BLOCK] = np.frombuffer(counts.as_py(), np.int64)
    return cells


def signatures(rows: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """``(node, n, fp, keys)`` per text: the number of its shingles, their SimHash, and the first of them, in
    order; shingles of cells that few texts hold stand before the others."""
    p, q = least
    given = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, width))

    def run(batches):
        cells = given.value
        for b in batches:
            for nodes, sets in _sets(b, width):
                sizes = np.array([len(s) for s in sets], np.int64)
                fps = _pieces(np.concatenate(sets).view(np.uint64), sizes)
                keys = []
                for h, n in zip(sets, sizes.tolist()):
                    h = h[np.lexsort((h, cells[_cell(h)]))]
                    keys.append(h[: n - -(-p * n // q) + 1])
                yield pa.RecordBatch.from_arrays([nodes, pa.array(sizes, pa.int32()), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["node", "n", "fp", "keys"])

    return rows.mapInArrow(tidy(run), "node long, n int, fp long, keys array<long>")


def _confirmed(pairs: DataFrame, found: DataFrame, rows: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough.

    The signatures throw most of the others out: of the text whose last key comes first in the order, nothing
    but the shingles behind its keys can be shared beyond the shared keys. Only texts of the pairs that
    are left are looked at again.
    """
    p, q = least
    enough = (F.col("na") + F.col("nb")) * p
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "pairs")
    held = found.select("node", "n", "keys").join(_ends(pairs), "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(held.toDF("a", "na", "ka"), "a").join(held.toDF("b", "nb", "kb"), "b")
    behind = F.greatest(F.col("na") - F.size("ka"), F.col("nb") - F.size("kb"))
    likely = materialize(both.filter((F.size(F.array_intersect("ka", "kb")) + behind) * (p + q) >= enough).select("a", "b"), "likely")
    needed = materialize(_ends(likely), "needed")
    # one text of each hash, before its shingles are made
    used = materialize(shingle_sets(rows.join(needed, "node", "left_semi").dropDuplicates(["node"]), width), "sets")
    both = likely.join(used.toDF("a", "na", "ha"), "a").join(used.toDF("b", "nb", "hb"), "b")
    out = materialize(both.filter(F.size(F.array_intersect("ha", "hb")) * (p + q) >= enough).select("a", "b"), "links")
    for df in (pairs, likely, needed, used):
        discard(df)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _may_reach(least: tuple[int, int]) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that share those at places ``i`` and ``j`` can be similar enough, if
    they share none before."""
    p, q = least
    return (1 + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))) * (p + q) >= (F.col("n") + F.col("m")) * p


def similar_links(docs: DataFrame, text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """``(a, b)``: confirmed links between text hashes that connect all texts with a similarity of at
    least ``least`` (a fraction), directly or over steps."""
    texts = _rows(docs, text_col)
    found = materialize(signatures(texts, width, least), "signatures")
    fps = found.select("node", "fp").distinct()
    heads = fps.groupBy("fp").agg(F.min("node").alias("head"))
    near = near_links(heads.select("fp"))
    ends = [heads.toDF(fp, node) for fp, node in (("a", "x"), ("b", "y"))]
    first = near.join(ends[0], "a").join(ends[1], "b").select("x", "y").union(fps.join(heads, "fp").select("head", "node"))

    rows = found.select("node", "n", F.posexplode("keys").alias("i", "key"))
    several = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key")
    shared = materialize(rows.join(several, "key").distinct(), "shared")
    star = F.min_by(F.struct(F.col("node").alias("a"), F.col("n").alias("m"), F.col("i").alias("j")), F.struct("i", F.xxhash64("node")))
    stars = shared.groupBy("key").agg(star.alias("c")).select("key", "c.*")
    linked = shared.join(stars, "key").filter(_may_reach(least)).select("a", F.col("node").alias("b"))
    links = _confirmed(first.toDF("a", "b").union(linked), found, texts, width, least)

    # only shingles that texts of more than one class share are paired
    classes = components(links).toDF("node", "class")
    every = shared.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    every = materialize(every, "labelled")
    apart = every.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("key")
    left = materialize(every.join(apart, "key"), "apart")
    right = left.select("key", F.col("node").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("class").alias("other"))
    pairs = left.join(right, "key").filter((F.col("class") < F.col("other")) & _may_reach(least)).select("a", F.col("node").alias("b"))
    more = _confirmed(pairs, found, texts, width, least)
    for df in (every, left, shared, found):
        discard(df)
    return links.union(more)


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """``(id, node, class, component_id)`` per row: near copies, also over steps, share ``class`` and the smallest
    id among them; ``node`` is a hash of the normalised text. Null texts count as empty; null ids take part."""
    rows = docs.select(F.col(id_col), F.xxhash64(normalised(F.col(text_col))).alias("node"))
    classes = components(similar_links(docs, text_col, width, least)).toDF("node", "__class")
    named = materialize(rows.join(classes, "node", "left").withColumn("class", F.coalesce("__class", "node")).drop("__class"), "named")
    owners = named.groupBy("class").agg(F.min(id_col).alias("component_id"))
    return named.join(owners, "class").select(id_col, "node", "class", "component_id")
