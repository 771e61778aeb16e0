"""Exact duplicates by Patricia-trie owners.

Rows are dealt out by the length and a hash of the normalised text. Each partition inserts the full
byte strings into one compressed radix trie per length, where texts share their common beginnings; a
terminal node stores the owner and the number of copies of its string. Equality is decided by the
bytes alone, never by a hash.

Copies within an input partition meet in a first trie there, so a text that a third of all rows
share travels once per input partition (and once more per spilled subtree), not once per row. When the
tries of a partition have grown past ``block_bytes``, their largest subtrees are written out and leave
memory until half of that is left. Rows arrive at the second trie sorted by length and hash, so
what it holds is complete whenever another hash begins: its subtrees are final when they spill, and a
whole trie is when its length ends. The first trie's subtrees may come again; the second one merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 32 << 20
_PARTS = "__len int, __hash long, __text binary, __owner long, __copies long"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


class _Node:
    __slots__ = ("label", "children", "owner", "copies", "digest")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.copies, self.digest = label, {}, None, 0, 0


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b[at:]`` have in common from the left, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie; ``better`` picks the owner of a string out of two ids. ``sizes`` holds about how
    many bytes each subtree below the root takes, ``bytes`` their sum."""

    def __init__(self, better=min):
        self.root, self.better, self.bytes, self.sizes = _Node(b""), better, 0, {}

    def insert(self, key: bytes, owner: int | None, copies: int = 1, digest: int = 0) -> None:
        node, at, grown = self.root, 0, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                grown += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = _common(child.label, key, at)
                fork = _Node(child.label[:n])
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                node.children[key[at]] = fork
                grown += 200
                node, at = fork, at + n
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)
        node.copies += copies
        node.digest = digest
        if grown:
            self.bytes += grown
            self.sizes[key[0]] = self.sizes.get(key[0], 0) + grown

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return ((key, node.owner, node.copies) for key, node in _terminals(self.root))

    def cut(self, first: int) -> _Node:
        """Take the subtree of the strings that begin with byte ``first`` out."""
        self.bytes -= self.sizes.pop(first)
        return self.root.children.pop(first)


def _terminals(top: _Node) -> Iterator[tuple[bytes, _Node]]:
    """Each string below a node, with the node where it ends."""
    stack = [(top, b"")]
    while stack:
        node, prefix = stack.pop()
        key = prefix + node.label
        if node.copies:
            yield key, node
        stack.extend((child, key) for child in node.children.values())


def _chunks(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``most`` bytes of the third column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[2])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _rows(batches, columns: int) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(part.column(i).to_pylist() for i in range(columns)))


def _tries(rows: Iterator[tuple], better, block: int, in_order: bool) -> Iterator[tuple]:
    """``(length, hash, text, owner, copies)`` of each text, from one trie per length; several times where
    subtrees were spilled and rows did not come in the order of their lengths and hashes."""
    tries: dict[int, PatriciaTrie] = {}
    size, last = 0, None

    def told(length: int, top: _Node) -> Iterator[tuple]:
        return ((length, node.digest, text, node.owner, node.copies) for text, node in _terminals(top))

    for length, digest, text, owner, copies in rows:
        if not in_order or (length, digest) != last:
            if in_order and last is not None and length != last[0]:
                yield from told(last[0], tries.pop(last[0]).root)
                size = 0
            if size > block:
                for part, n, first in sorted(((b, n, f) for n, t in tries.items() for f, b in t.sizes.items()), reverse=True):
                    if size <= block // 2:
                        break
                    yield from told(n, tries[n].cut(first))
                    size -= part
            last = (length, digest)
        trie = tries.get(length)
        if trie is None:
            trie = tries[length] = PatriciaTrie(better)
        before = trie.bytes
        trie.insert(text, owner, copies, digest)
        size += trie.bytes - before
    for n, trie in tries.items():
        yield from told(n, trie.root)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the smallest
    id stays (``keep="largest"``: the largest). Null texts count as empty, and all empty texts are
    one group. A null id never owns a group unless all ids of the group are null; its rows are
    kept only in that case. Rows that repeat id and text are the same document: they count in
    ``group_size`` and share the verdict. An empty table gives no rows; other columns are ignored.
    """
    better = {"smallest": min, "largest": max}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("__owner"), normalised(F.col(text_col)).alias("__norm"))
    sent = rows.select(
        F.octet_length("__norm").alias("__len"), F.xxhash64("__norm").alias("__hash"),
        F.encode("__norm", "UTF-8").alias("__text"), "__owner", F.lit(1).cast("long").alias("__copies"),
    )
    schema = pa.schema([("__len", pa.int32()), ("__hash", pa.int64()), ("__text", pa.binary()), ("__owner", pa.int64()), ("__copies", pa.int64())])
    out = pa.schema([("__sha", pa.binary()), ("__keep", pa.int64()), ("group_size", pa.int64())])

    def combine(batches):
        yield from _chunks(_tries(_rows(batches, 5), better, block_bytes, False), schema, 4 << 20)

    def merge(batches):
        yield from _owners(_tries(_rows(batches, 5), better, block_bytes, True), out)

    owners = (
        sent.mapInArrow(combine, _PARTS)
        .repartition("__len", "__hash")
        .sortWithinPartitions("__len", "__hash")
        .mapInArrow(merge, "__sha binary, __keep long, group_size long")
    )
    members = rows.select("__owner", F.unhex(F.sha2(F.encode("__norm", "UTF-8"), 256)).alias("__sha"))
    return members.join(owners, "__sha").select(
        F.col("__owner").alias(id_col), F.col("__keep").alias("keep_id"), "group_size",
        F.col("__owner").eqNullSafe(F.col("__keep")).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def _owners(found: Iterator[tuple], schema: pa.Schema, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for _, _, text, owner, copies in found:
        held.append((hashlib.sha256(text).digest(), owner, copies))
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
