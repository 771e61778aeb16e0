"""Rename detection: which dropped name became which created name.

Similar names are found by an equi-join on *signatures*, never by pairing whole groups. A pair
that passes the threshold has a Jaro score above a known bound, so its names share at least a
known number of characters, counted with repetition. Where hardly any character may differ, a
name is filed under each set of characters that may be the shared one. Else: if names of lengths
``la`` and ``lb`` share ``c`` characters, any ``la-c+1`` and ``lb-c+1`` of them, taken in one
common order, have one in common (the prefix filter of set-similarity joins), so a name is filed
under its few rarest characters. Both per common start, own length and partner length. Only
names filed under the same signature meet; no pair is lost, and a scope that holds most of the
names is spread over many keys.

Names all alike meet under nearly every signature, so signatures save nothing there. Where by
counts more time would go into meeting than into scoring, names of two lengths are paired in
*tiles*: a block of names of each side, whose pairs are scored together and are rows only once
they have passed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablechange.functions.render import field, row_key_text
from tablechange.functions.similarity import (
    BLOCK_LENGTH,
    BOOST_FLOOR,
    PREFIX_CAP,
    PREFIX_WEIGHT,
    THRESHOLD,
    block_scores,
    jaro_winkler_scores,
)
from tablechange.operators.diff import change_rows, changed, diff
from tablechange.session import discard, materialize

_EXACT_LENGTHS = 64
_TOKENS_RANKED = 4000
_FEW_PAIRS = 50_000_000  # up to this many, bands are not worth their jobs
_CLASS_ROWS = 16000
_COMPACT = 25  # rounds after which their results become one table
BANDS = (0.975, 0.95, 0.925, 0.9, 0.875, 0.85)
_PART_PAIRS = 50_000_000  # possible pairs under one signature, above which it is split
_MOST_PARTS = 32
_SUBSETS = 100  # up to this many, a name is filed under whole sets of shared characters
_START = -1  # the token of names whose common start is enough
_TILED_FROM = 100_000  # possible pairs, below which signatures are always used
_TILE = 500  # names of a side in a tile
_TILE_TASK = 8_000_000  # pairs of a task
# seconds, roughly: a signature, names meeting under one, a pair of them, a tile, its pairs by character
_SIGNED, _MET, _PAIRED, _TILED, _SCORED = 3e-6, 2e-6, 8e-6, 2e-3, 6e-9


def _length_class(n: int) -> int:
    """Lengths up to 64 stand alone, longer ones share classes that grow by a tenth."""
    if n <= _EXACT_LENGTHS:
        return n
    return _EXACT_LENGTHS + 1 + int(math.log(n / (_EXACT_LENGTHS + 1)) / math.log(1.1) + 1e-9)


@lru_cache(maxsize=None)
def _class_range(c: int) -> tuple[int, int]:
    if c <= _EXACT_LENGTHS:
        return c, c
    lo = int((_EXACT_LENGTHS + 1) * 1.1 ** (c - _EXACT_LENGTHS - 1))
    while _length_class(lo) < c:
        lo += 1
    while lo > _EXACT_LENGTHS + 1 and _length_class(lo - 1) >= c:
        lo -= 1
    hi = lo
    while _length_class(hi + 1) <= c:
        hi += 1
    return lo, hi


class _Bounds:
    """What a pair must satisfy to score above ``threshold``."""

    def __init__(self, threshold: float, weight: float, cap: int | None, floor: float):
        self.threshold, self.weight, self.floor = threshold, weight, floor
        # with the whole common start counting, nothing is gained beyond the length at which
        # the start alone is enough
        enough = math.ceil(threshold / weight) if weight > 0 else 0
        self.starts = min(cap, enough) if cap is not None else enough
        self._overlap: dict[tuple[int, int, int], int | None] = {}

    def jaro_bound(self, start: int) -> float:
        """A pair with this common start passes only with a Jaro score above the result."""
        lift = self.weight * start
        if lift >= 1:
            return min(self.threshold, self.floor)
        return min(self.threshold, max(self.floor, (self.threshold - lift) / (1 - lift)))

    def overlap(self, start: int, class_a: int, class_b: int) -> int | None:
        """Least number of shared characters over all lengths of the two classes; None when no
        pair can pass. Jaro is at most (c/la + c/lb + 1)/3."""
        known = (start, class_a, class_b)
        if known not in self._overlap:
            if class_a == 0 or class_b == 0:
                # two empty names are equal, an empty one is unlike any other
                return 0 if class_a == class_b else None
            need = 3 * self.jaro_bound(start) - 1
            (a_lo, a_hi), (b_lo, b_hi) = _class_range(class_a), _class_range(class_b)
            best = None
            # the bound grows with both lengths, but c may not exceed the shorter one
            for la in range(a_lo, a_hi + 1):
                lb = max(b_lo, math.floor((need - 1) * la + 1e-9))
                while lb <= b_hi:
                    c = max(1, math.floor(need * la * lb / (la + lb) - 1e-9) + 1)
                    if c <= min(la, lb):
                        best = c if best is None else min(best, c)
                        break
                    if lb >= la:
                        break
                    lb += 1
            self._overlap[known] = best
        return self._overlap[known]


    def possible(self, class_a: int, class_b: int) -> bool:
        """Whether any pair of names of the two classes can pass."""
        shorter = min(_class_range(class_a)[1], _class_range(class_b)[1])
        return any(self.overlap(s, class_a, class_b) is not None for s in range(min(self.starts, shorter) + 1))

    def by_subsets(self, start: int, class_a: int, class_b: int) -> bool:
        """Whether so few characters may differ that the whole shared part can be the key. Both
        sides decide alike, because it depends on the two lengths only."""
        need = self.overlap(start, class_a, class_b)
        if need is None or max(class_a, class_b) > _EXACT_LENGTHS:
            return False
        return all(math.comb(n - start, n - need) <= _SUBSETS for n in (class_a, class_b))


def _subsets(text: str, size: int) -> list[int]:
    """All sets of ``size`` of the characters of ``text``, counted with repetition, as sorted hashes."""
    found = set(combinations(sorted(text), size))
    return sorted(int.from_bytes(blake2b("".join(s).encode(), digest_size=8).digest(), "big", signed=True) for s in found)


def _token(ch: str, nth: int, ranks: dict[tuple[str, int], int]) -> int:
    return (ranks.get((ch, nth), 0) << 45) | (ord(ch) << 24) | min(nth, (1 << 24) - 1)


def _ranked_tokens(text: str, ranks: dict[tuple[str, int], int]) -> list[int]:
    """The characters of ``text`` with their repetition, rarest first, each as one number."""
    seen: Counter = Counter()
    out = []
    for ch in text:
        seen[ch] += 1
        out.append(_token(ch, seen[ch], ranks))
    return sorted(out)


@dataclass
class _Profile:
    """What the names of both sides look like, small whatever the data."""

    ranks: dict[tuple[str, int], int]
    counts: dict[str, int]
    classes: dict[str, dict[int, int]]
    by_first: dict[str, dict[str, dict[int, int]]] | None
    parts: dict[int, int]
    shares: np.ndarray  # of the ranked characters, rarest first: in which part of the old and of the new names
    lengths: dict[tuple[int, int], tuple[int, int]] | None = None

    def partners(self, side: str, first: str) -> dict[int, int]:
        """Length classes on a side among names that begin with a character."""
        return self.classes[side] if self.by_first is None else self.by_first[side].get(first, {})

    def same_first(self, class_a: int, class_b: int) -> float:
        """The part of the pairs of two classes that begin with the same character, over all groups."""
        if self.by_first is None:
            return 1.0
        pairs = self.classes["old"].get(class_a, 0) * self.classes["new"].get(class_b, 0)
        same = sum(cs.get(class_a, 0) * self.partners("new", ch).get(class_b, 0) for ch, cs in self.by_first["old"].items())
        return same / pairs if pairs else 0.0

    def meeting(self, kept_a: int, kept_b: int) -> float:
        """How often a pair meets that is filed under so many of its rarest characters, if these are
        in a name independently."""
        under = [np.clip(kept - (np.cumsum(p) - p), 0, p) for kept, p in zip((kept_a, kept_b), self.shares)]
        return float(under[0] @ under[1])

    def sharing(self, need: int) -> float:
        """The part of the pairs that share so many characters, likewise."""
        both = self.shares[0] * self.shares[1]
        mean, spread = both.sum(), math.sqrt(2 * (both * (1 - both)).sum())
        return 0.5 * math.erfc((need - 0.5 - mean) / max(spread, 1e-9))


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of characters with their repetition, per side, and of names per side, length
    class and first character."""
    for batch in batches:
        total: dict[str, Counter] = {"old": Counter(), "new": Counter()}
        for side, name in zip(batch["side"], batch["name"]):
            mine = total[side]
            mine[(side, name[:1], _length_class(len(name)))] += 1
            seen: Counter = Counter()
            for ch in name:
                seen[ch] += 1
                mine[("", ch, seen[ch])] += 1
        rows = [(*key, total["old"][key], total["new"][key]) for key in total["old"] | total["new"]]
        yield pd.DataFrame(rows, columns=["side", "ch", "nth", "old", "new"])


def _largest_group(names: DataFrame) -> int:
    """The most pairs that one group can have."""
    group = [c for c in names.columns if c not in ("side", "name")]
    sides = names.groupBy(*group).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("old", "new")])
    return int(sides.agg(F.max(F.col("old").cast("double") * F.col("new"))).first()[0] or 0)


def _read_profile(names: DataFrame) -> _Profile:
    """Ranks of the characters by the pairs of names that have them (any other one counts as
    rarer, as does one that only one side has; the order matters for speed only) and the length
    classes per first character. The driver reads a bounded number of rows; with more first
    characters than that, all classes count for each."""
    counts = names.select("side", "name").mapInPandas(_profile, "side string, ch string, nth long, old long, new long")
    counts = counts.groupBy("side", "ch", "nth").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    is_class = F.col("side") != ""
    pairs = F.col("old").cast("double") * F.col("new")
    counts = counts.withColumn("n", F.when(is_class, (F.col("old") + F.col("new")).cast("double")).otherwise(pairs))
    rows = counts.orderBy(F.desc(is_class), F.desc("n"), "side", "ch", "nth").limit(_TOKENS_RANKED + _CLASS_ROWS).collect()
    found = [r for r in rows if r["side"]]
    complete = len(found) < _CLASS_ROWS
    if complete:
        top = [r for r in rows if not r["side"]][:_TOKENS_RANKED]
    else:
        top = counts.filter(~is_class).orderBy(F.desc("n"), "ch", "nth").limit(_TOKENS_RANKED).collect()
        # at most 64 + log(longest)/log(1.1) classes per side
        found = counts.filter(is_class).groupBy("side", F.lit("").alias("ch"), "nth").agg(F.sum("n").alias("n")).collect()
    sizes, by_first = {"old": 0, "new": 0}, {"old": {}, "new": {}}
    for r in found:
        sizes[r["side"]] += int(r["n"])
        by_first[r["side"]].setdefault(r["ch"], {})[r["nth"]] = int(r["n"])
    every = {side: sum(map(Counter, firsts.values()), Counter()) for side, firsts in by_first.items()}
    classes = {side: dict(sorted(counts.items())) for side, counts in every.items()}
    ranks = {(r["ch"], r["nth"]): rank for rank, r in enumerate(reversed(top), start=1)}
    # what one key would leave to one task is split: evenly spread over the groups, a character
    # is in this share of the pairs of the largest one
    size, parts = sizes["old"] * sizes["new"], {}
    if size > _PART_PAIRS:
        largest = _largest_group(names)
        shares = {_START: 1.0} | {_token(r["ch"], r["nth"], ranks): r["old"] * r["new"] / size for r in top}
        parts = {token: min(math.ceil(share * largest / _PART_PAIRS), _MOST_PARTS) for token, share in shares.items()}
        parts = {token: n for token, n in parts.items() if n > 1}
    shares = np.array([[r[side] / max(sizes[side], 1) for r in reversed(top)] for side in ("old", "new")])
    return _Profile(ranks, sizes, classes, by_first if complete else None, parts, shares)


def _length_pairs(names: DataFrame, profile: _Profile, group: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """Of each two lengths up to ``BLOCK_LENGTH`` that meet in a group: the pairs and the tiles of all groups."""
    if profile.lengths is None and not group:
        olds, news = ([(n, c) for n, c in profile.classes[side].items() if 0 < n <= BLOCK_LENGTH] for side in ("old", "new"))
        profile.lengths = {(a, b): (x * y, math.ceil(x / _TILE) * math.ceil(y / _TILE)) for a, x in olds for b, y in news}
    if profile.lengths is None:
        known = names.withColumn("__n", F.length("name")).filter(F.col("__n").between(1, BLOCK_LENGTH))
        counts = known.groupBy("side", *group, "__n").agg(F.count(F.lit(1)).cast("double").alias("__names"))
        o, n = counts.filter("side = 'old'").alias("o"), _shuffled(counts.filter("side = 'new'")).alias("n")
        blocks = F.ceil(F.col("o.__names") / _TILE) * F.ceil(F.col("n.__names") / _TILE)
        pairs = o.join(n, [F.col(f"o.`{g}`") == F.col(f"n.`{g}`") for g in group]).groupBy(F.col("o.__n").alias("a"), F.col("n.__n").alias("b")).agg(
            F.sum(F.col("o.__names") * F.col("n.__names")).alias("pairs"), F.sum(blocks).alias("tiles")
        )
        profile.lengths = {(r["a"], r["b"]): (int(r["pairs"]), int(r["tiles"])) for r in pairs.collect()}
    return profile.lengths


def _signing_time(bounds: _Bounds, profile: _Profile, a: int, b: int, pairs: int) -> float:
    """About how long it takes to find the similar names of two lengths by signatures."""
    olds, news, same_first, total = profile.classes["old"].get(a, 0), profile.classes["new"].get(b, 0), profile.same_first(a, b), 0.0
    for start in range(min(bounds.starts, a, b) + 1):
        need, meet = bounds.overlap(start, a, b), pairs * (same_first if start else 1.0)
        if need is None or need > min(a, b) or not meet:
            continue
        if need <= start:
            total += _SIGNED * (olds + news) + (_MET + _PAIRED) * meet
        elif bounds.by_subsets(start, a, b):
            filed = olds * math.comb(a - start, need - start) + news * math.comb(b - start, need - start)
            total += _SIGNED * filed + (_MET + _PAIRED) * meet * profile.sharing(need)
        else:
            kept_a, kept_b = a - need + 1, b - need + 1
            often = profile.meeting(kept_a, kept_b)
            total += _SIGNED * (olds * kept_a + news * kept_b) + meet * (_MET * often + _PAIRED * min(often, 1.0))
    return total


def _tiled_lengths(names: DataFrame, profile: _Profile, group: list[str], bounds: _Bounds) -> dict[tuple[int, int], int]:
    """The pairs of lengths whose names are paired in tiles, each with its pairs of names."""
    if profile.counts["old"] * profile.counts["new"] < _TILED_FROM:
        return {}
    return {
        (a, b): pairs
        for (a, b), (pairs, tiles) in _length_pairs(names, profile, group).items()
        if bounds.possible(a, b) and pairs * max(a, 4) * _SCORED + tiles * _TILED < _signing_time(bounds, profile, a, b, pairs)
    }


def _signer(bounds: _Bounds, profile: _Profile, side: str, tiled: frozenset[tuple[int, int]]):
    """A function for ``mapInArrow``: ``(group..., name)`` in, one row per signature out, but for
    partners of lengths that are paired in tiles."""
    partner = "new" if side == "old" else "old"

    def signatures(name: str) -> Iterator[tuple[int, int, int, list[int], bool]]:
        own = _length_class(len(name))
        near = profile.partners(partner, name[:1])
        for start in range(min(bounds.starts, len(name)) + 1):
            rest = None
            for other in near if start else profile.classes[partner]:
                a, b = (own, other) if side == "old" else (other, own)
                need = bounds.overlap(start, a, b)
                if need is None or need > len(name) or (a, b) in tiled:
                    continue
                need -= start
                if need <= 0:
                    # the common start is enough: nothing more to file under
                    yield start, a, b, [_START], False
                    continue
                if bounds.by_subsets(start, a, b):
                    yield start, a, b, _subsets(name[start:], need), True
                    continue
                rest = _ranked_tokens(name[start:], profile.ranks) if rest is None else rest
                yield start, a, b, rest[: len(rest) - need + 1], False

    # of a signature in parts, the smaller side goes to each part and the other to one
    copied = profile.counts[side] < profile.counts[partner] or (profile.counts[side] == profile.counts[partner] and side == "old")

    def flush(batch: pa.RecordBatch, index, starts, las, lbs, heads, tokens, parts, lists, offsets) -> pa.RecordBatch:
        taken = batch.take(pa.array(index, pa.int64()))
        groups = list(zip(batch.schema.names, taken.columns))
        columns = [
            *groups[:-1],
            ("start", pa.array(starts, pa.int32())),
            ("la", pa.array(las, pa.int32())),
            ("lb", pa.array(lbs, pa.int32())),
            ("head", pa.array(heads, pa.string())),
            ("token", pa.array(tokens, pa.int64())),
            ("part", pa.array(parts, pa.int32())),
            ("tokens", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists, pa.int64()))),
            (side, groups[-1][1]),
        ]
        return pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fill = [[] for _ in range(8)] + [[0]]
            index, starts, las, lbs, heads, tokens, parts, lists, offsets = fill
            for i, name in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spot = crc32(name.encode("utf-8", "surrogatepass"))
                for start, a, b, kept, subsets in signatures(name):
                    under = [(t, 1 if subsets else profile.parts.get(t, 1)) for t in kept]
                    under = [(t, p) for t, n in under for p in (range(n) if copied else [spot % n])]
                    n = len(under)
                    index += [i] * n
                    starts += [start] * n
                    las += [a] * n
                    lbs += [b] * n
                    heads += [name[:start]] * n
                    tokens += [t for t, _ in under]
                    parts += [p for _, p in under]
                    for _ in range(n):
                        lists += kept
                        offsets.append(len(lists))
                if len(index) > 20000:
                    yield flush(batch, *fill)
                    fill = [[] for _ in range(8)] + [[0]]
                    index, starts, las, lbs, heads, tokens, parts, lists, offsets = fill
            if index:
                yield flush(batch, *fill)

    return sign


@dataclass
class _Scorer:
    """The parameters of Jaro-Winkler."""

    prefix_weight: float = PREFIX_WEIGHT
    prefix_cap: int | None = PREFIX_CAP
    boost_floor: float = BOOST_FLOOR

    def above(self, threshold: float):
        """A function for ``mapInPandas``: pairs in, those above the threshold out with their score."""

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch.rename(columns={"old": "old_name", "new": "new_name"})
                batch["score"] = jaro_winkler_scores(
                    batch["old_name"].tolist(), batch["new_name"].tolist(), self.prefix_weight, self.prefix_cap, self.boost_floor
                )
                yield batch[batch["score"] > threshold]

        return score

    def tiles_above(self, threshold: float):
        """A function for ``mapInArrow``: ``(group..., old, new)`` with the names of a tile in, the pairs
        above the threshold out with their score."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for batch in batches:
                *groups, olds, news = batch.columns
                for i in range(batch.num_rows):
                    left, right, first = olds[i].values, news[i].values, 0
                    for scores in block_scores(left.to_pylist(), right.to_pylist(), self.prefix_weight, self.prefix_cap, self.boost_floor):
                        found = np.flatnonzero(scores > threshold)
                        if len(found):
                            a, b = np.divmod(found, scores.shape[1])
                            row = pa.array(np.full(len(found), i))
                            taken = [g.take(row) for g in groups] + [left.take(pa.array(a + first)), right.take(pa.array(b))]
                            held.append(pa.RecordBatch.from_arrays(
                                [*taken, pa.array(scores.ravel()[found])], [*batch.schema.names[:-2], "old_name", "new_name", "score"]
                            ))
                            rows += len(found)
                        first += len(scores)
                        if rows > 20000:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, rows = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        return score


def _shuffled(df: DataFrame) -> DataFrame:
    """For a side of a join: both sides are shuffled. Written tables of names are packed to a small part of
    their rows, so taken for small they would be broadcast, and a broadcast goes through the driver whole."""
    return df.hint("merge")


def _group(on: list[str] | str | None) -> list[str]:
    return [on] if isinstance(on, str) else list(on or [])


def _names(dropped: DataFrame, created: DataFrame, group: list[str], name: str) -> DataFrame:
    """The distinct names of both sides per group, written once: ``(side, group..., name)``."""
    cols = [F.col(g) for g in group]
    olds = dropped.select(F.lit("old").alias("side"), *cols, F.col(name).alias("name"))
    news = created.select(F.lit("new").alias("side"), *cols, F.col(name).alias("name"))
    return materialize(olds.unionByName(news).filter("name IS NOT NULL").distinct(), "names")


def _fields(df: DataFrame, group: list[str]) -> list[str]:
    return [f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group]


def _scored_pairs(names: DataFrame, profile: _Profile, group: list[str], threshold: float, scorer: _Scorer) -> DataFrame:
    bounds = _Bounds(threshold, scorer.prefix_weight, scorer.prefix_cap, scorer.boost_floor)
    tiled = _tiled_lengths(names, profile, group, bounds)
    every = {(a, b) for a in profile.classes["old"] for b in profile.classes["new"]}
    # lengths that never meet in a group need no signatures either
    apart = set() if profile.lengths is None else {p for p in every - {*profile.lengths} if min(p) > 0 and max(p) <= BLOCK_LENGTH}
    done = frozenset(apart | {*tiled})
    by_signature = _pairs_by_signature(names, profile, group, threshold, scorer, bounds, done)
    if not tiled:
        return by_signature
    tiles = _pairs_in_tiles(names, profile, group, threshold, scorer, tiled)
    return tiles.unionByName(by_signature) if any(bounds.possible(*pair) for pair in every - done) else tiles


def _pairs_in_tiles(
    names: DataFrame, profile: _Profile, group: list[str], threshold: float, scorer: _Scorer, tiled: dict[tuple[int, int], int]
) -> DataFrame:
    """The similar names of some pairs of lengths. Names of one group and length are cut into blocks, in their
    order, so that a block read again is the same one; a tile is a row with a block of each side."""
    cores = names.sparkSession.sparkContext.defaultParallelism
    total = sum(tiled.values())
    # tiles may be small, and a task reads many rows at once
    rows = sum(profile.lengths[pair][1] for pair in tiled)
    spread = max(min(total // 500_000, 8 * cores), math.ceil(total / _TILE_TASK), rows // 1000, 1)
    own, cols = "__n", [F.col(f"`{g}`") for g in group]

    def blocks(side: str, place: int) -> DataFrame:
        partners: dict[int, list[int]] = {}
        for pair in tiled:
            partners.setdefault(pair[place], []).append(pair[1 - place])
        count = sum(profile.classes[side].get(n, 0) for n in partners)
        pieces = max(min(count // 200, cores), count // 20000, 1)
        mine = names.filter(F.col("side") == side).withColumn(own, F.length("name")).filter(F.col(own).isin([*partners]))
        mine = mine.repartition(pieces, *cols, own).sortWithinPartitions(*cols, own, "name")
        mine = mine.withColumn("__block", F.floor(F.monotonically_increasing_id() / _TILE))
        cut = mine.groupBy(*cols, own, "__block").agg(F.collect_list("name").alias(side))
        others = F.create_map(*[c for n, ms in partners.items() for c in (F.lit(n), F.array(*map(F.lit, sorted(ms))))])
        return cut.select(*cols, F.col(own).alias(("la", "lb")[place]), F.explode(others[F.col(own)]).alias(("lb", "la")[place]), side)

    tiles = blocks("old", 0).join(_shuffled(blocks("new", 1)), [*group, "la", "lb"]).select(*cols, "old", "new")
    schema = ", ".join([*_fields(names, group), "old_name string, new_name string, score double"])
    return tiles.repartition(spread).mapInArrow(scorer.tiles_above(threshold), schema)


def _pairs_by_signature(
    names: DataFrame,
    profile: _Profile,
    group: list[str],
    threshold: float,
    scorer: _Scorer,
    bounds: _Bounds,
    tiled: frozenset[tuple[int, int]],
) -> DataFrame:
    fields = _fields(names, group)
    key = ", ".join([*fields, "start int, la int, lb int, head string, token long, part int, tokens array<long>"])
    cores = names.sparkSession.sparkContext.defaultParallelism
    size = profile.counts["old"] * profile.counts["new"]
    spread = max(min(size // 500_000, 8 * cores), sum(profile.counts.values()) // 10000, 1)
    keys = [*group, "start", "la", "lb", "head", "token", "part"]

    def signatures(side: str) -> DataFrame:
        # names are few bytes but much work: small pieces, so that all cores take part
        count = profile.counts[side]
        pieces = max(min(count // 200, cores), count // 20000, 1)
        mine = names.filter(F.col("side") == side).drop("side").repartition(pieces)
        signed = mine.mapInArrow(_signer(bounds, profile, side, tiled), f"{key}, {side} string")
        return signed.repartition(spread, *[F.col(f"`{c}`") for c in keys])

    # a pair is taken at its exact common start and at its first shared character only, so it
    # appears once and no distinct is needed
    # a name has many signatures, of which the size of the names says nothing: taken for small,
    # they would go through the driver whole, so neither side may be broadcast
    o, n = signatures("old").alias("o"), _shuffled(signatures("new")).alias("n")
    same = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in keys]
    next_old = F.substring(F.col("o.old"), F.col("o.start") + 1, F.lit(1))
    next_new = F.substring(F.col("n.new"), F.col("n.start") + 1, F.lit(1))
    once = (F.col("o.start") == bounds.starts) | (next_old != next_new) | (next_old == "")
    first = F.array_min(F.array_intersect(F.col("o.tokens"), F.col("n.tokens"))) == F.col("o.token")
    pairs = o.join(n, same).filter(once & first).select(*[F.col(f"o.{g}") for g in group], "old", "new")
    return pairs.mapInPandas(scorer.above(threshold), ", ".join([*fields, "old_name string, new_name string, score double"]))


@dataclass
class _Search:
    """Where pairs come from, so that matching them need not write them all."""

    names: DataFrame
    profile: _Profile
    on: list[str]
    wide: list[str]
    threshold: float
    scorer: _Scorer


def similar_pairs(
    dropped: DataFrame,
    created: DataFrame,
    on: list[str] | str | None = None,
    threshold: float = THRESHOLD,
    block: str | None = None,
    name: str = "name",
    **weights,
) -> DataFrame:
    """``(on..., old_name, new_name, score)`` for all pairs of a dropped and a created name of
    the same ``on`` columns that score strictly above ``threshold``; each distinct name once.

    ``block`` is one more column that must agree. It may lose renames that change the block, so
    it is the caller's choice. ``weights``: ``prefix_weight``, ``prefix_cap``, ``boost_floor``.
    """
    group = _group(on) + ([block] if block and block not in _group(on) else [])
    names, scorer = _names(dropped, created, group, name), _Scorer(**weights)
    profile = _read_profile(names)
    found = _scored_pairs(names, profile, group, threshold, scorer).select(*_group(on), "old_name", "new_name", "score")
    found._search = _Search(names, profile, _group(on), group, threshold, scorer)
    return found


def match_one_to_one(pairs: DataFrame, on: list[str] | str | None = None, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """Each old and each new name at most once: the greedy choice by ``(score desc, md5 of the pair,
    old, new)``, where the pair is both names with a zero character between.

    A pair that is the best of both its names is what the greedy would take, so all of those are
    taken at once, their names leave, and the rest goes on. The best per name is a partial
    aggregate (a minimum), so a name with very many partners is no hot key. Equal scores are taken
    in the order of a hash: ties by name would settle one pair per round, a random order takes a
    number of rounds that grows with the logarithm of the names. Every round takes a pair, so it
    always ends.

    The result of ``similar_pairs``, as it is, is matched in ``bands`` of its scores: the same
    choice, but the pairs of names that a higher band has matched are never built.
    """
    group, search = _group(on), getattr(pairs, "_search", None)
    if search is not None and search.on == group:
        return _match_in_bands(search, bands)
    return _match_rounds(pairs, group)


def _match_rounds(pairs: DataFrame, group: list[str]) -> DataFrame:
    """The matching, over pairs that are all written."""
    tie = F.md5(F.concat(F.col("old_name"), F.chr(F.lit(0)), F.col("new_name")))
    rank = F.struct((-F.col("score")).alias("s"), tie.alias("t"), F.col("old_name").alias("o"), F.col("new_name").alias("n"))
    rest, taken = materialize(pairs.select(*group, "old_name", "new_name", "score"), "pairs"), None
    round_number = 0
    while not rest.isEmpty():
        round_number += 1
        by_old = rest.groupBy(*group, "old_name").agg(F.min(rank).alias("best"))
        by_new = rest.groupBy(*group, "new_name").agg(F.min(rank).alias("best"))
        left = by_old.select(*group, "old_name", F.col("best.n").alias("new_name"), (-F.col("best.s")).alias("score"))
        right = by_new.select(*group, F.col("best.o").alias("old_name"), "new_name")
        chosen = materialize(left.join(_shuffled(right), [*group, "old_name", "new_name"]), "matches")
        taken = chosen if taken is None else taken.unionByName(chosen)
        if round_number % _COMPACT == 0:
            taken = materialize(taken, "matches")
        left_over = rest.join(_shuffled(chosen.select(*group, "old_name")), [*group, "old_name"], "left_anti")
        left_over = left_over.join(_shuffled(chosen.select(*group, "new_name")), [*group, "new_name"], "left_anti")
        rest = materialize(left_over.select(*group, "old_name", "new_name", "score"), "pairs", replaces=rest)
    return rest if taken is None else taken


def _match_in_bands(search: _Search, bands: tuple[float, ...]) -> DataFrame:
    """The greedy takes high scores first, so the names are matched above the highest band, the
    matched ones leave, and only the remaining names go on to the next band, down to the
    threshold. The result is the same; a scope of very many names all alike needs only its
    near-equal pairs. Few names (counted first) go straight to the threshold."""
    group, names, profile, taken = search.on, search.names, search.profile, None
    levels = [*sorted((b for b in bands if b > search.threshold), reverse=True), search.threshold]
    while levels:
        size = profile.counts["old"] * profile.counts["new"]
        if size == 0:
            break
        level = search.threshold if size <= _FEW_PAIRS else levels[0]
        levels = levels[levels.index(level) + 1 :]
        pairs = _scored_pairs(names, profile, search.wide, level, search.scorer)
        found = _match_rounds(pairs.select(*group, "old_name", "new_name", "score"), group)
        taken = found if taken is None else taken.unionByName(found)
        if levels:
            side = F.explode(
                F.array(
                    F.struct(F.lit("old").alias("side"), F.col("old_name").alias("name")),
                    F.struct(F.lit("new").alias("side"), F.col("new_name").alias("name")),
                )
            )
            used = found.select(*group, side.alias("u")).select(*group, "u.side", "u.name")
            left = names.join(_shuffled(used), [*group, "side", "name"], "left_anti").select(names.columns)
            # the pairs that were handed over still read the first names
            names = materialize(left, "names", replaces=None if names is search.names else names)
            profile = _read_profile(names)
    if taken is None:
        schema = ", ".join([*_fields(names, group), "old_name string, new_name string, score double"])
        taken = names.sparkSession.createDataFrame([], schema)
    return taken


def match_names(
    dropped: DataFrame,
    created: DataFrame,
    on: list[str] | str | None = None,
    threshold: float = THRESHOLD,
    block: str | None = None,
    name: str = "name",
    bands: tuple[float, ...] = BANDS,
    **weights,
) -> DataFrame:
    """``match_one_to_one(similar_pairs(...))``, for those who do not need the pairs. The result
    reads written tables, so using it more than once costs no second search."""
    pairs = similar_pairs(dropped, created, on, threshold, block, name, **weights)
    matches = match_one_to_one(pairs, on, bands)
    discard(pairs._search.names)
    return matches


def fold_renames(
    changes: DataFrame,
    matches: DataFrame,
    scoped: bool = True,
    kinds: tuple[str, str, str] = ("create", "drop", "rename"),
) -> DataFrame:
    """Each matched drop and create becomes one rename holding both definitions; the unmatched
    stay. ``kinds`` names the three, ``scoped`` says whether ``matches`` has a ``scope`` column."""
    create, drop, rename = kinds
    on = ["scope", "key"] if scoped else ["key"]
    scope = [F.col("scope")] if scoped else []
    used = matches.select(
        *scope,
        F.explode(
            F.array(
                F.struct(F.lit(create).alias("kind"), F.col("new_name").alias("key")),
                F.struct(F.lit(drop).alias("kind"), F.col("old_name").alias("key")),
            )
        ).alias("u"),
    ).select(*scope, "u.kind", "u.key")
    rest = changes.join(_shuffled(used), ["kind", *on], "left_anti")
    gone = changes.filter(F.col("kind") == drop).select(*scope, F.col("key").alias("old_name"), "old_value")
    come = changes.filter(F.col("kind") == create).select(*scope, F.col("key").alias("new_name"), "new_value")
    by = ["scope"] if scoped else []
    pairs = matches.join(_shuffled(gone), [*by, "old_name"]).join(_shuffled(come), [*by, "new_name"])
    renamed = pairs.select(
        F.lit(rename).alias("kind"),
        *scope,
        F.col("new_name").alias("key"),
        F.col("old_name").alias("old_key"),
        "old_value",
        "new_value",
        "score",
    )
    return rest.select(changes.columns).unionByName(change_rows(renamed))


def diff_with_renames(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    attrs: list[str] | None = None,
    block: str | None = None,
    threshold: float = THRESHOLD,
    **weights,
) -> DataFrame:
    """``diff`` with renames folded, and the attributes that changed under a rename as ``change``
    rows that carry the old key."""
    attrs = [c for c in new.columns if c not in keys and c != block] if attrs is None else attrs
    changes = materialize(diff(old, new, keys, attrs, scope=block), "changes")
    on = "scope" if block else None
    columns = [*(["scope"] if block else []), F.col("key").alias("name")]
    gone = changes.filter("kind = 'drop'").select(*columns)
    come = changes.filter("kind = 'create'").select(*columns)
    matches = match_names(gone, come, on, threshold, **weights)
    folded = fold_renames(changes, matches, scoped=block is not None)

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(row_key_text(df, keys).alias("__key"), *[field(a) for a in attrs])

    was = keyed(old).join(_shuffled(matches.select(F.col("old_name").alias("__key"), "old_name", "new_name")), "__key")
    now = keyed(new).join(_shuffled(matches.select(F.col("new_name").alias("__key"))), "__key", "left_semi")
    moved = was.drop("__key").withColumnRenamed("new_name", "__key")
    under = changed(moved, _shuffled(now), ["__key"], attrs).select(F.col("__key").alias("new_name"), "column", "old_value", "new_value")
    under = under.join(_shuffled(matches.drop("score")), "new_name").select(
        F.lit("change").alias("kind"),
        *([F.col("scope")] if block else []),
        F.col("new_name").alias("key"),
        F.col("old_name").alias("old_key"),
        "column",
        "old_value",
        "new_value",
    )
    return folded.unionByName(change_rows(under))
