"""Jaro and Jaro-Winkler similarity.

``jaro`` and ``jaro_winkler`` score whole Arrow batches: the matching loop runs over character
positions while numpy handles all pairs of the batch at once. ``block_scores`` scores each text of
one list with each of another, where a text is one word of bits per character. ``jaro_column`` says
the same with built-in functions only; it is far slower and serves as the tested definition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# fixed values: Winkler's published weight, prefix length and boost floor; threshold for a rename
PREFIX_WEIGHT = 0.1
PREFIX_CAP = 4
BOOST_FLOOR = 0.7
THRESHOLD = 0.8

_CELLS = 1 << 20  # characters held per chunk and side
_BLOCK_PAIRS = 1 << 15  # pairs scored at once, so that they stay in the processor's cache
BLOCK_LENGTH = 64  # bits of a word


def _encode(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one zero-padded matrix of code points (or UTF-8 bytes), and their lengths."""
    if unit == "bytes":
        raw, kind = [t.encode("utf-8", "surrogatepass") for t in texts], np.uint8
    else:
        raw, kind = [t.encode("utf-32-le", "surrogatepass") for t in texts], np.uint32
    size = np.dtype(kind).itemsize
    lengths = np.fromiter((len(r) // size for r in raw), dtype=np.int64, count=len(raw))
    matrix = np.zeros((len(raw), max(int(lengths.max(initial=0)), 1)), dtype=kind)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(raw), dtype=kind)
    return matrix, lengths


def _score_chunk(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, wide = len(la), b.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    most = int(reach.max(initial=0))
    free = np.arange(wide) < lb[:, None]
    hit_a = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        lo, hi = max(0, i - most), min(wide, i + most + 1)
        if lo >= hi:
            break
        near = np.abs(np.arange(lo, hi) - i) <= reach[:, None]
        match = free[:, lo:hi] & near & (b[:, lo:hi] == a[:, i : i + 1]) & (i < la)[:, None]
        found = match.any(axis=1)
        hit_a[:, i] = found
        rows = np.flatnonzero(found)
        free[rows, lo + match[rows].argmax(axis=1)] = False
    hit_b = ~free & (np.arange(wide) < lb[:, None])
    m = hit_a.sum(axis=1)
    top = int(m.max(initial=0))
    seq_a = np.take_along_axis(a, np.argsort(~hit_a, axis=1, kind="stable")[:, :top], axis=1)
    seq_b = np.take_along_axis(b, np.argsort(~hit_b, axis=1, kind="stable")[:, :top], axis=1)
    moved = ((seq_a != seq_b) & (np.arange(top) < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / la + m / lb + (m - moved) / m) / 3.0
    return np.where(m > 0, score, np.where((la == 0) & (lb == 0), 1.0, 0.0))


def jaro_scores(left: list[str], right: list[str], unit: str = "char") -> np.ndarray:
    """Jaro similarity of each pair."""
    out = np.ones(len(left))
    todo = [i for i, (x, y) in enumerate(zip(left, right)) if x != y]
    todo.sort(key=lambda i: max(len(left[i]), len(right[i])))
    start = 0
    while start < len(todo):
        # sorted by length, so the last text of a chunk sets its width
        end = min(len(todo), start + 4096)
        width = 4 * max(len(left[todo[end - 1]]), len(right[todo[end - 1]]), 1)
        while end > start + 1 and (end - start) * width > _CELLS:
            end = start + max(1, (end - start) // 2)
            width = 4 * max(len(left[todo[end - 1]]), len(right[todo[end - 1]]), 1)
        part = todo[start:end]
        a, la = _encode([left[i] for i in part], unit)
        b, lb = _encode([right[i] for i in part], unit)
        out[part] = _score_chunk(a, la, b, lb)
        start = end
    return out


def _common_prefix(x: str, y: str, cap: int | None, unit: str) -> int:
    if unit == "bytes":
        x, y = x.encode("utf-8", "surrogatepass"), y.encode("utf-8", "surrogatepass")
    most = min(len(x), len(y)) if cap is None else min(len(x), len(y), cap)
    n = 0
    while n < most and x[n] == y[n]:
        n += 1
    return n


def jaro_winkler_scores(
    left: list[str],
    right: list[str],
    prefix_weight: float = PREFIX_WEIGHT,
    prefix_cap: int | None = PREFIX_CAP,
    boost_floor: float = BOOST_FLOOR,
    unit: str = "char",
) -> np.ndarray:
    """Jaro similarity, raised by the common prefix where it lies above the floor."""
    base = jaro_scores(left, right, unit)
    prefix = np.fromiter(
        (_common_prefix(x, y, prefix_cap, unit) for x, y in zip(left, right)), dtype=np.int64, count=len(left)
    )
    boosted = np.minimum(base + prefix_weight * prefix * (1.0 - base), 1.0)
    return np.where(base > boost_floor, boosted, base)


@lru_cache(maxsize=32)
def _score_table(la: int, lb: int, prefix_weight: float, prefix_cap: int, boost_floor: float) -> np.ndarray:
    """The score of texts of two lengths by shared characters, moved ones and common start."""
    least = min(la, lb)
    m, moved, prefix = np.ogrid[: least + 1, : least // 2 + 1, : prefix_cap + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3.0, 0.0)
    boosted = np.minimum(base + prefix_weight * prefix * (1.0 - base), 1.0)
    return np.where(base > boost_floor, boosted, base)


def _matched(masks: list[np.ndarray], la: int, lb: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared and moved characters of pairs of texts of two lengths. ``masks[i]`` has a bit for each
    place at which the second text has character ``i`` of the first."""
    kind, shape = masks[0].dtype.type, masks[0].shape
    reach, every = max(max(la, lb) // 2 - 1, 0), kind((1 << lb) - 1)
    free, low, other = np.full(shape, every, kind), np.empty(shape, kind), np.empty(shape, kind)
    hits = []
    for i in range(min(la, lb + reach)):
        window = (1 << min(lb, i + reach + 1)) - (1 << max(0, i - reach))
        np.bitwise_and(masks[i], free, out=low)
        np.bitwise_and(low, kind(window), out=low)
        np.bitwise_and(low, np.negative(low, out=other), out=low)
        np.bitwise_xor(free, low, out=free)
        hits.append(low != 0)
    rest = free ^ every
    m, moved = np.bitwise_count(rest), np.zeros(shape, np.uint8)
    for mask, hit in zip(masks, hits):
        np.bitwise_and(rest, np.negative(rest, out=other), out=low)
        np.multiply(low, hit, out=low)
        np.bitwise_xor(rest, low, out=rest)
        moved += np.bitwise_and(mask, low, out=other) != low
    return m, moved >> 1


def block_scores(
    left: list[str],
    right: list[str],
    prefix_weight: float = PREFIX_WEIGHT,
    prefix_cap: int | None = PREFIX_CAP,
    boost_floor: float = BOOST_FLOOR,
) -> Iterator[np.ndarray]:
    """``jaro_winkler_scores`` of each text of ``left`` with each of ``right``, some rows of ``left`` at
    a time. The texts of a side have one length, from 1 to ``BLOCK_LENGTH`` characters."""
    (a, _), (b, _) = _encode(left, "char"), _encode(right, "char")
    (la, lb), many = (a.shape[1], b.shape[1]), b.shape[0]
    most = min(la, lb) if prefix_cap is None else min(la, lb, prefix_cap)
    table = _score_table(la, lb, prefix_weight, most, boost_floor)
    kind = np.uint32 if max(la, lb) <= 32 else np.uint64
    step = max(1, _BLOCK_PAIRS // many)
    # a mask per character and text; texts of very many different characters get them anew for each slice
    known = np.unique(b).size * many <= _CELLS
    for first in range(0, len(a), step):
        part = a[first : first + step]
        if first == 0 or not known:
            chars = np.intersect1d(a if known else part, b)
            places = np.zeros((len(chars) + 1, many), kind)
            for j, at in enumerate(_positions(chars, b).T):
                places[at, np.arange(many)] |= kind(1 << j)
            places[-1] = 0
        masks = [places[at] for at in _positions(chars, part).T]
        m, moved = _matched(masks, la, lb)
        prefix, same = np.zeros(m.shape, np.uint8), np.ones(m.shape, bool)
        for i in range(most):
            same &= (masks[i] & kind(1 << i)) != 0
            prefix += same
        yield table[m, moved, prefix]


def _positions(chars: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where each character stands among ``chars``, which are sorted; their number for any other."""
    at = np.searchsorted(chars, texts)
    return np.where(np.append(chars, 0)[at] == texts, at, len(chars)) if len(chars) else np.zeros_like(at)


def _pair_udf(scorer):
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            known = (a.notna() & b.notna()).to_numpy()
            out = np.full(len(a), np.nan)
            out[known] = scorer(a[known].tolist(), b[known].tolist())
            yield pd.Series(out).where(known, None)

    return score


def jaro(a: Column | str, b: Column | str, unit: str = "char") -> Column:
    """Jaro similarity of two text columns; null when either is null."""
    return _pair_udf(lambda x, y: jaro_scores(x, y, unit))(a, b)


def jaro_winkler(
    a: Column | str,
    b: Column | str,
    prefix_weight: float = PREFIX_WEIGHT,
    prefix_cap: int | None = PREFIX_CAP,
    boost_floor: float = BOOST_FLOOR,
    unit: str = "char",
) -> Column:
    """Jaro-Winkler similarity of two text columns. ``prefix_cap=None, boost_floor=0`` gives the
    looser form in which every common prefix counts in full."""
    return _pair_udf(lambda x, y: jaro_winkler_scores(x, y, prefix_weight, prefix_cap, boost_floor, unit))(a, b)


def jaro_column(a: Column, b: Column) -> Column:
    """Jaro similarity from built-in functions, by its definition."""

    def chars(s: Column) -> Column:
        return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(
            F.array().cast("array<string>")
        )

    ca, cb, la, lb = chars(a), chars(b), F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))

    def step(acc: Column, i: Column) -> Column:
        lo, hi = F.greatest(i - reach, F.lit(1)), F.least(i + reach, lb)
        window = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        taken = acc["b"]
        j = F.try_element_at(
            F.filter(window, lambda k: (F.get(cb, k - 1) == F.get(ca, i - 1)) & ~F.array_contains(taken, k)), F.lit(1)
        )
        return F.when(j.isNull(), acc).otherwise(
            F.struct(F.array_append(taken, j).alias("b"), F.array_append(acc["a"], F.get(ca, i - 1)).alias("a"))
        )

    start = F.struct(F.array().cast("array<int>").alias("b"), F.array().cast("array<string>").alias("a"))
    positions = F.when(la > 0, F.sequence(F.lit(1), la)).otherwise(F.array().cast("array<int>"))

    def finish(acc: Column) -> Column:
        m = F.size(acc["b"]).cast("double")
        in_order = F.transform(F.array_sort(acc["b"]), lambda k: F.get(cb, k - 1))
        moved = F.floor(F.size(F.filter(F.zip_with(acc["a"], in_order, lambda x, y: x != y), lambda d: d)) / 2)
        return F.when(m == 0, F.when((la == 0) & (lb == 0), 1.0).otherwise(0.0)).otherwise(
            (m / la + m / lb + (m - moved) / m) / 3
        )

    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(positions, start, step, finish))


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """Jaro-Winkler with the published parameters, from built-in functions."""
    base = jaro_column(a, b)
    same = [
        F.when((F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.least(F.length(a), F.length(b)) >= n), 1).otherwise(0)
        for n in range(1, PREFIX_CAP + 1)
    ]
    prefix = sum(same[1:], same[0])
    return F.when(base > BOOST_FLOOR, base + PREFIX_WEIGHT * prefix * (1 - base)).otherwise(base)
