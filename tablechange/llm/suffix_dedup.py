"""Removal of repeated substrings by blockwise suffix sorting with difference covers.

Which bytes go: those covered by a string of ``width`` bytes that starts at two or more places of the
corpus, in the same text or in others. All such strings are suffixes cut at ``width`` bytes, so they
are found by sorting suffixes to that depth.

Suffix buckets. A suffix belongs to the bucket of its *anchor*: of the ``ANCHOR``-byte strings in its
first ``width`` bytes the one with the smallest hash (the leftmost of equal ones). Equal suffixes
have equal anchors, so buckets can be sorted on their own, and neighbouring suffixes mostly share
theirs: a run of suffixes with one anchor is kept as one *fragment* of text, which needs about one
row per 90 bytes. Fragments of one bucket with equal text are counted, not sorted. A bucket with a
single fragment text needs no order: its suffixes are repeated if the fragment is, else not.

Sorting a bucket. Buckets with several fragment texts are taken block by block. The positions of a
difference cover modulo ``PERIOD`` are ranked first, by doubling over the cover itself. Suffixes are
then sorted by their first 8 bytes, and ties by a ternary partition whose comparison looks at the
head, at the precomputed ranks of a pair of cover positions that both suffixes reach at the same
distance (there always is one), and at the tail. So long ties cost a table lookup and memory is
bounded by the block, however long the repeats are.

Hot anchors. Copies of a fragment are added up before it moves, so a passage that very many texts share is
one row of its bucket. A bucket with more than ``BUCKET_ROWS`` different fragment texts is not put into
one task: its suffixes are counted by 128-bit hashes with partial aggregates instead. Nothing is
capped or left out.

What moves: the fragments' hashes twice, whole texts to the places where the fragments of their id
meet, and each fragment text of mixed buckets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablechange.session import materialize

WIDTH, ANCHOR, PERIOD = 200, 32, 32
SEGMENT = 1 << 19  # suffixes of a text looked at together
BLOCK = 400_000  # suffixes sorted together, whole buckets
BUCKET_ROWS = 30_000
_POSITION_BITS = 20


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` occurs between two of them, found greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda c: len({(c - d) % period for d in cover} & missing | {(d - c) % period for d in cover} & missing))
        missing -= {(best - d) % period for d in cover} | {(d - best) % period for d in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)
_HEAD = 40  # bytes compared before the cover ranks; a common cover position lies 8 to 39 bytes on
_SHIFT = np.array([[next(s for s in range(8, 8 + PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def anchors(text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(start, anchor)`` of each fragment of a text of less than 2^20 bytes; both empty if it is
    shorter than ``width``."""
    n = len(text) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    power, size = 0xD6E8FEB86659FD93, 1
    while size < ANCHOR:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the position in the low bits makes the leftmost of equal hashes the smallest
    low = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
    span, size = width - ANCHOR + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return starts, (low[starts] >> np.uint64(_POSITION_BITS)).astype(np.int64)


def fragments(raw: bytes, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Per segment of a text: start, number of suffixes, anchor and text hash of its fragments."""
    text = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(raw) - width + 1), SEGMENT):
        part = text[at : at + SEGMENT + width - 1]
        starts, anchor = anchors(part, width)
        counts = np.diff(np.append(starts, len(part) - width + 1))
        starts = starts + at
        digest = xxhash.xxh3_64_intdigest
        texts = [digest(raw[s:e]) for s, e in zip(starts.tolist(), (starts + counts + width - 1).tolist())]
        yield starts, counts, anchor, texts


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples of keys, equal tuples alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class CoverRanks:
    """Ranks of the text at all cover positions, to a depth of 160 bytes."""

    def __init__(self, text: np.ndarray, words: np.ndarray):
        self.words = words
        at = np.arange(len(text) - 7)
        sample = at[np.isin(at % PERIOD, COVER)]
        self.place = np.full(len(text) + 1, -1, np.int64)
        self.place[sample] = np.arange(len(sample))

        def later(names: np.ndarray, by: int) -> np.ndarray:
            to = sample + by
            known = self.place[np.minimum(to, len(text))]
            return np.where((to < len(text)) & (known >= 0), names[known], -1)

        inside = [np.where(sample + k < len(words), words[np.minimum(sample + k, len(words) - 1)], 0) for k in (0, 8, 16, 24)]
        name = _names(*inside)
        name = _names(name, later(name, 32))
        name = _names(name, later(name, 64))
        self.rank = _names(name, later(name, 32))

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.rank[self.place[positions]]


def repeated_suffixes(texts: list[bytes], weights: list[int], buckets: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each fragment text a mask over its suffixes: whether their first ``width`` bytes occur at
    least twice in its bucket, a fragment counting ``weights`` times."""
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(">u8").ravel().astype(np.uint64)
    firsts = np.cumsum(sizes) - sizes
    counts = sizes - width + 1
    frag = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    start = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts) + firsts[frag]
    weight = np.array(weights)[frag]
    out = np.zeros(len(start), bool)
    out[weight > 1] = True
    group = np.array(buckets)[frag]
    # the first key of the suffix order: bucket and 8 bytes
    order = np.lexsort((words[start], group))
    b, w = group[order], words[start[order]]
    group = np.concatenate([[0], np.cumsum((b[1:] != b[:-1]) | (w[1:] != w[:-1]))])
    order, group = _without_singles(order, group)
    if len(order):
        cover = CoverRanks(text, words)
    middle = [k for k in range(8, _HEAD, 8)]
    tail = [width - 32 + k for k in range(0, 32, 8)]
    while len(order):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(heads, len(order)))
        pivot = np.repeat(start[order[heads + sizes // 2]], sizes)
        here = start[order]
        sign = np.zeros(len(order), np.int8)
        for k in middle:
            _compare(sign, words[here + k], words[pivot + k])
        shift = _SHIFT[here % PERIOD, pivot % PERIOD]
        _compare(sign, cover.at(here + shift), cover.at(pivot + shift))
        for k in tail:
            _compare(sign, words[here + k], words[pivot + k])
        same = sign == 0
        total = np.add.reduceat(np.where(same, weight[order], 0), heads)
        out[order[same & np.repeat(total >= 2, sizes)]] = True
        order, group, sign = order[~same], group[~same], sign[~same]
        key = group * 2 + (sign > 0)
        again = np.argsort(key, kind="stable")
        order, group = _without_singles(order[again], key[again])
    return np.split(out, ends[:-1])


def _compare(sign: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    tied = sign == 0
    sign[tied & (a > b)] = 1
    sign[tied & (a < b)] = -1


def _without_singles(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(order):
        return order, group
    new = np.concatenate([[True], group[1:] != group[:-1]])
    alone = new & np.append(new[1:], True)
    return order[~alone], np.cumsum(new)[~alone]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the lists of their id and text hash. All joins deal out the same columns of ``docs``
    by the same keys, so that within one plan the texts are shuffled once and read again."""
    named = lists.withColumnsRenamed({"__id": "__of", "__th": "__oh"})
    return docs.join(named, docs["__id"].eqNullSafe(F.col("__of")) & (docs["__th"] == F.col("__oh")), how)


def repeated_ranges(docs: DataFrame, width: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(__id, __th, start, runs)``: fragments of the texts, and the runs of their suffixes whose first ``width``
    bytes are repeated, as ``(off, len)`` from the fragment's start. ``docs`` has ``__id``, ``__th`` (which name a text) and ``__raw`` (its bytes)."""

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, hashes, columns = part.column(0), part.column(1), [[], [], [], [], []]
                for i in range(part.num_rows):
                    for starts, counts, anchor, texts in fragments(part.column(2)[i].as_py(), width):
                        for c, x in zip(columns, (np.full(len(starts), i), starts, counts, anchor, np.array(texts, np.uint64).view(np.int64))):
                            c.append(x)
                if columns[0]:
                    row, *rest = (np.concatenate(c) for c in columns)
                    row = pa.array(row)
                    arrays = [ids.take(row), hashes.take(row), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int32(), pa.int64(), pa.int64())))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["__id", "__th", "start", "n", "a", "f"])

    pieces = materialize(docs.select("__id", "__th", "__raw").mapInArrow(cut, "__id long, __th long, start int, n int, a long, f long"), "fragments")
    seen = pieces.groupBy("a").agg(F.count("*").alias("rows"), F.min("f").alias("least"), F.max("f").alias("most")).filter("rows > 1")
    # written: the join then has a measured side and can split a hot anchor
    seen = materialize(seen.select("a", (F.col("least") != F.col("most")).alias("mixed")), "anchors")
    shared = materialize(pieces.join(seen, "a"), "shared", replaces=pieces)

    # Buckets with several fragment texts: each text once, with the number of its copies and one place to
    # read it. Copies are added up before anything moves.
    mixed = shared.filter("mixed")
    place = [F.first(c).alias(c) for c in ("__id", "__th", "start", "n")]
    texts = materialize(mixed.groupBy("a", "f").agg(F.count("*").alias("c"), *place), "texts")
    large = materialize(texts.groupBy("a").agg(F.count("*").alias("texts")).filter(F.col("texts") > bucket_rows).select("a", F.lit(2).alias("k")), "large")
    entry = F.struct("start", "n", "a", "f", "c", F.coalesce("k", F.lit(1)).alias("kind"))
    wanted = texts.join(large, "a", "left").groupBy("__id", "__th").agg(F.collect_list(entry).alias("wanted"))
    full = _with_lists(docs, wanted, "inner")
    sent = pa.schema([("a", pa.int64()), ("f", pa.int64()), ("c", pa.int64()), ("text", pa.binary())])

    def take(kind):
        def run(batches):
            held, size = [], 0
            for b in batches:
                raws, lists = b.column(0), b.column(1)
                for i in range(b.num_rows):
                    raw = raws[i].as_py()
                    for w in lists[i].as_py():
                        if w["kind"] == kind:
                            text = raw[w["start"] : w["start"] + w["n"] + width - 1]
                            held.append((w["a"], w["f"], w["c"], text))
                            size += len(text) + 64
                    if size > 4 << 20:
                        yield _batch(held, sent)
                        held, size = [], 0
            if held:
                yield _batch(held, sent)

        return run

    found = pa.schema([("a", pa.int64()), ("f", pa.int64()), ("runs", pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32())])))])

    def sort(batches):
        block: dict[tuple[int, int], tuple[bytes, int]] = {}
        size, last, held = 0, None, []
        for b in batches:
            for a, f, c, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if size >= BLOCK and a != last:
                    held += _sorted_block(block, width)
                    block, size = {}, 0
                    if len(held) > 8192:
                        yield _batch(held, found)
                        held = []
                if (a, f) not in block:  # rows that repeat id and text bring a fragment again
                    block[a, f] = text, c
                    size += len(text) - width + 1
                last = a
        held += _sorted_block(block, width)
        if held:
            yield _batch(held, found)

    columns, piece, run_list = full.select("__raw", "wanted"), "a long, f long, c long, text binary", "a long, f long, runs array<struct<off:int,len:int>>"
    runs = columns.mapInArrow(take(1), piece).repartition("a").sortWithinPartitions("a", "f").mapInArrow(sort, run_list)

    def windows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for a, f, c, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    for k in range(len(text) - width + 1):
                        h = xxhash.xxh3_128_intdigest(text[k : k + width])
                        rows.append((a, f, c, k, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
                if rows:
                    yield _batch(rows, pa.schema([("a", pa.int64()), ("f", pa.int64()), ("c", pa.int64()), ("off", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))

    if not large.isEmpty():
        hot = columns.mapInArrow(take(2), piece).dropDuplicates(["a", "f"]).mapInArrow(windows, "a long, f long, c long, off int, h1 long, h2 long")
        twice = hot.groupBy("h1", "h2").agg(F.sum("c").alias("c")).filter("c > 1").select("h1", "h2")
        # one row for each text, with at most as many places as it has suffixes
        places = F.collect_list(F.struct("off", F.lit(1).alias("len"))).alias("runs")
        runs = runs.unionByName(hot.join(twice, ["h1", "h2"]).groupBy("a", "f").agg(places))

    whole = shared.filter("NOT mixed").select("__id", "__th", "start", F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("len"))).alias("runs"))
    # one row for each copy
    return whole.unionByName(mixed.join(materialize(runs, "runs"), ["a", "f"]).select("__id", "__th", "start", "runs"))


def _sorted_block(block: dict[tuple[int, int], tuple[bytes, int]], width: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    if not block:
        return []
    keys = list(block)
    number = {a: i for i, a in enumerate(dict.fromkeys(a for a, _ in keys))}
    masks = repeated_suffixes([block[k][0] for k in keys], [block[k][1] for k in keys], [number[a] for a, _ in keys], width)
    return [(*k, _runs(mask)) for k, mask in zip(keys, masks) if mask.any()]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` per row: bytes of the text, bytes removed, the maximal
    removed runs as ``(start, end)`` in bytes, and the remaining bytes put together.

    Texts are judged as UTF-8 bytes on the input, matches never cross texts. Null texts count as
    empty; texts shorter than ``width`` keep all bytes. Rows that repeat a text repeat its strings,
    so all its bytes from ``width`` on go in both. Null ids are kept. An empty table gives no rows;
    other columns are ignored. ``width`` is at least 200.
    """
    if width < WIDTH:
        raise ValueError(f"width must be at least {WIDTH}")
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), raw.alias("__raw")).withColumn("__th", F.xxhash64("__raw"))
    ranges = repeated_ranges(rows, width, bucket_rows)
    # a set: rows that repeat id and text bring the same fragments
    listed = ranges.groupBy("__id", "__th").agg(F.collect_set(F.struct("start", "runs")).alias("ranges"))
    joined = _with_lists(rows, listed, "left").select("__id", "__raw", "ranges")
    schema = "__id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = ([], [], [], [])
                for i in range(part.num_rows):
                    raw, spans = part.column(1)[i].as_py(), []
                    for s, n in sorted((r["start"] + x["off"], x["len"]) for r in part.column(2)[i].as_py() or () for x in r["runs"]):
                        e = s + n + width - 1
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([s, e])
                    kept, last = [], 0
                    for s, e in spans:
                        kept.append(raw[last:s])
                        last = e
                    kept.append(raw[last:])
                    for column, x in zip(out, (len(raw), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], b"".join(kept))):
                        column.append(x)
                arrays = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], arrow), pa.array(out[3], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["__id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, schema).withColumnRenamed("__id", id_col)
