"""SimHash near-duplicates with BK-trees.

Fingerprints are made distinct first, so copies cost nothing. Two fingerprints that differ in at
most ``radius`` bits agree in at least one of ``radius + 1`` blocks of bits; each block value is a
shard, and each shard holds a BK-tree of its fingerprints. The tree is searched with every
fingerprint of the shard as it is put in: children are keyed by their Hamming distance to the
parent, and only edges within the radius are followed.

A shard with more than ``SHARD`` fingerprints is divided again by the blocks of its remaining
bits, and so on. As fingerprints are distinct, that ends; no shard is capped or cut. Trees grow
with the corpus, so they meet their queries through the shuffle and are not broadcast.

A shard gives its links as a forest of at most one edge per fingerprint, never all pairs. Classes
of linked fingerprints are then joined across shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablechange.llm.components import components
from tablechange.session import discard, materialize

SHARD = 4096
SEED = 42
_SLICE = 4 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of one text (see ``simhash_fingerprints``)."""
    hashes = _shingle_hashes((text or "").encode("utf-8"), width)
    return int(_majority(np.array(hashes, np.uint64), np.array([len(hashes)]))[0]) if hashes else 0


def _shingle_hashes(raw: bytes, width: int) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist())]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes (all at least 1), the bits set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: the SimHash of each whole text as a signed long.

    A-Z are lower-cased; words are runs of other bytes than space and the controls 9 to 13;
    shingles of ``width`` words count as often as they occur; fewer words are one shingle; no
    words (also null) give zero.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("__text"))

    def run(batches):
        for b in batches:
            ids, texts, at = b.column(0), b.column(1), 0
            while at < len(texts):
                stop, size, hashes, counts = at, 0, [], []
                while stop < len(texts) and size < _SLICE:
                    raw = texts[stop].as_py()
                    found = _shingle_hashes(raw, width)
                    size += len(raw)
                    counts.append(len(found))
                    hashes.append(np.array(found, np.uint64))
                    stop += 1
                n = np.array(counts)
                fps = np.zeros(len(n), np.uint64)
                if (n > 0).any():
                    # very long texts are summed in pieces of the same bound
                    fps[n > 0] = _pieces(np.concatenate(hashes), n[n > 0])
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array(fps.view(np.int64))], names=["__id", "fp"])
                at = stop

    return rows.mapInArrow(run, "__id long, fp long").withColumnRenamed("__id", id_col)


def _pieces(hashes: np.ndarray, counts: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """``_majority`` over groups of runs; 64 bytes a hash, so one run over ``most`` goes in parts."""
    out, run, at = [], 0, 0
    while run < len(counts):
        stop = run + 1
        while stop < len(counts) and counts[run : stop + 1].sum() <= most:
            stop += 1
        size = int(counts[run:stop].sum())
        if size <= most:
            out.append(_majority(hashes[at : at + size], counts[run:stop]))
        else:
            ones = np.zeros(64, np.int64)
            for a in range(at, at + size, most):
                part = hashes[a : min(a + most, at + size)]
                ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out.append(np.packbits(ones * 2 > size).view(">u8").astype(np.uint64))
        run, at = stop, at + size
    return np.concatenate(out)


class BKTree:
    """A BK-tree over integers under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            node = 0
            while True:
                d = (self.values[node] ^ value).bit_count()
                if d == 0:
                    return
                child = self.children[node].get(d)
                if child is None:
                    self.children[node][d] = len(self.values)
                    break
                node = child
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """The numbers of the nodes at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = self.children[node]
            if len(edges) <= 2 * radius + 1:
                stack.extend([child for edge, child in edges.items() if -radius <= edge - d <= radius])
            else:
                stack.extend([edges[e] for e in range(d - radius, d + radius + 1) if e in edges])
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A forest over distinct fingerprints that links what lies within the radius, also over steps."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        tree.add(value)
        me = len(parent)
        parent.append(me)
        for other in near:
            a, b = root(other), root(me)
            if a != b:
                parent[b] = a
                links.append((value, tree.values[other]))
    return links


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(free), parts)]


def _bits(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _refine(level: DataFrame, radius: int) -> DataFrame:
    """Rows ``(shard, free, fp)`` dealt out by the blocks of their free bits.

    ``free`` is the mask of bits not used by earlier blocks. All shards of one level have one of
    few masks, so the masks are handled one by one as constants.
    """
    masks = [r[0] for r in level.select("free").distinct().collect()]
    out = None
    for mask in masks:
        free = [b for b in range(64) if (mask >> b) & 1]
        rows = level.filter(F.col("free") == mask)
        keys = [
            F.struct(F.xxhash64("shard", F.lit(i), _bits(F.col("fp"), block)).alias("shard"), F.lit(_signed(mask & ~sum(1 << b for b in block))).alias("free"))
            for i, block in enumerate(_blocks(free, radius + 1))
        ]
        part = rows.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.shard", "k.free", "fp")
        out = part if out is None else out.union(part)
    return level if out is None else out


def _signed(mask: int) -> int:
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that connect all those within
    ``radius`` bits, directly or over steps."""
    level = fps.select(F.lit(0).cast("long").alias("shard"), F.lit(-1).cast("long").alias("free"), "fp")
    ready, used, depth = None, [], 0
    while True:
        level = materialize(_refine(level, radius), "shards")
        used.append(level)
        sizes = level.groupBy("shard").agg(F.count("*").alias("n"))
        depth += 1
        big = sizes.filter((F.col("n") > shard) & F.lit(depth * 4 * (radius + 1) < 64)).select("shard")
        if depth * 4 * (radius + 1) >= 64 or big.isEmpty():
            ready = level if ready is None else ready.union(level)
            break
        big = materialize(big, "big")
        used.append(big)
        small = level.join(big, "shard", "left_anti")
        ready = small if ready is None else ready.union(small)
        level = level.join(big, "shard")

    def trees(batches):
        key, values, out = None, [], []

        def flush():
            if len(values) > 1:
                out.extend(shard_links(values, radius))

        for b in batches:
            for s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != key:
                    flush()
                    key, values = s, []
                values.append(v & 0xFFFFFFFFFFFFFFFF)
            if len(out) > 8192:
                yield _pairs(out)
                out.clear()
        flush()
        if out:
            yield _pairs(out)

    dealt = ready.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    links = materialize(dealt.mapInArrow(trees, "a long, b long").distinct(), "links")
    for df in used:
        discard(df)
    return links


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["a", "b"])


def simhash_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, shard: int = SHARD
) -> DataFrame:
    """``(id, fp, component_id)`` per row: documents whose fingerprints are linked, also over steps,
    share the smallest id among them.

    Rows with a null id take part in linking, and their class can be null only if all its ids are.
    Repeated rows are repeated in the result. Empty and null texts have fingerprint zero, linked
    like any other. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(simhash_fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("__least")), "distinct")
    links = near_links(least.select("fp"), radius, shard)
    classes = components(links).toDF("fp", "__class")
    named = least.join(classes, "fp", "left").select("fp", F.coalesce("__class", "fp").alias("__class"), "__least")
    owners = named.groupBy("__class").agg(F.min("__least").alias("component_id"))
    verdict = named.join(owners, "__class").select("fp", "component_id")
    return rows.join(verdict, "fp").select(id_col, "fp", "component_id")
