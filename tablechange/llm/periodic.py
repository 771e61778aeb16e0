"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q and at least ``max(least, 2 q)`` words that no
neighbour extends. So its first ``max(q, least - q)`` words are followed by a copy of themselves at
distance q. The method works at dyadic scales: at scale B the text is cut into blocks of B words, and
the periods q with B as the largest power of two such that ``2 B - 1 <= max(q, least - q)`` are looked
for; those words then hold a whole block, whatever its place.

Where a block occurs again in the window that follows it is found by a convolution: with words as
numbers, the sum of squared differences is zero there. It is computed for all distances of the
window at once by number-theoretic transforms, exactly modulo ``PRIME``, for many blocks in one batch.
A block takes part only if each pair of neighbouring words in it comes again within the scale's
distances; without that it has no occurrence. Zeros are seeds ``(place, distance)``: the words are
compared from there in both directions, which also throws out sums that are a multiple of the prime.

Distances go upwards, so runs of smaller periods are known when a multiple of their period shows up;
seeds inside such a run are dropped together. That keeps texts of one repeated word near linear.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablechange.llm.bpe import _slices

LEAST = 12
PRIME, ROOT = 998244353, 3  # 119 * 2^23 + 1 and a primitive root of it
BATCH = 1 << 18  # numbers transformed together
LONGEST = 1 << 21  # words of a block that are looked for, and distances in one transform
SLICE_BYTES = 1 << 20
_P = np.uint64(PRIME)


@lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``, as a column."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % _P])
    return out[: max(1, size // 2), None]


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each column, places in bit-reversed order; the input is overwritten."""
    size, width = a.shape
    n = size
    while n > 1:
        v = a.reshape(size // n, n, width)
        low, high = v[:, : n // 2], v[:, n // 2 :]
        diff = (low + (_P - high)) * _powers(n, False) % _P
        low += high
        low %= _P
        high[...] = diff
        n //= 2
    return a


def transform_back(a: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``; the input is overwritten."""
    size, width = a.shape
    n = 2
    while n <= size:
        v = a.reshape(size // n, n, width)
        low, high = v[:, : n // 2], v[:, n // 2 :]
        turned = high * _powers(n, True) % _P
        high[...] = (low + (_P - turned)) % _P
        low += turned
        low %= _P
        n *= 2
    a *= np.uint64(pow(size, PRIME - 2, PRIME))
    a %= _P
    return a


def occurrences(words: np.ndarray, at: np.ndarray, block: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, distance)``: where blocks of ``block`` words at ``at`` occur ``lo`` to ``hi`` words later,
    by the sum of squared differences modulo the prime. ``words`` are numbers from 0. Of a block beyond
    ``LONGEST`` words only as many are looked for, as transforms of this prime end at 2^23."""
    if hi - lo >= LONGEST:
        parts = [occurrences(words, at, block, k, min(k + LONGEST - 1, hi)) for k in range(lo, hi + 1, LONGEST)]
        return tuple(np.concatenate(p) for p in zip(*parts))
    n, lags, block = len(words), hi - lo + 1, min(block, LONGEST)
    size = 1 << (lags + block - 2).bit_length()
    found = ([], [])
    step = max(1, BATCH // size)
    for k in range(0, len(at), step):
        here = at[k : k + step]
        x = words[here + np.arange(block)[:, None]]
        places = here + lo + np.arange(lags + block - 1)[:, None]
        y = np.where(places < n, words[np.minimum(places, n - 1)], 0)
        left, right = (np.zeros((size, len(here)), np.uint64) for _ in range(2))
        left[-np.arange(block)] = x  # reversed, so that the product correlates
        right[: len(y)] = y
        cross = transform_back(transform(left) * transform(right) % _P)[:lags].astype(np.int64)
        squares = np.cumsum(np.concatenate([np.zeros((1, len(here)), np.int64), y * y % PRIME]), axis=0)
        total = (x * x % PRIME).sum(0) + squares[block : block + lags] - squares[:lags] - 2 * cross
        total[here + lo + np.arange(lags)[:, None] + block > n] = 1  # the window ends before
        lag, which = np.nonzero(total % PRIME == 0)
        found[0].append(here[which])
        found[1].append(lag + lo)
    return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)


def _scales(n: int, least: int) -> dict[int, tuple[int, int]]:
    """The block length of each scale with its smallest and largest period, for a text of ``n`` words."""
    out: dict[int, tuple[int, int]] = {}
    q = 1
    while 2 * q <= n:
        block = 1 << ((max(q, least - q) + 1) // 2).bit_length() - 1
        # from the middle of ``least`` on, all periods up to the next power share a block
        last = min(4 * block - 2, n // 2) if q >= least - q else q
        out[block] = (min(q, out.get(block, (q, q))[0]), last)
        q = last + 1
    return out


def _block_of(period: np.ndarray, least: int) -> np.ndarray:
    return 1 << np.floor(np.log2((np.maximum(period, least - period) + 1) // 2)).astype(np.int64)


def _until(words: np.ndarray, i: int, d: int) -> int:
    """The first place from ``i`` on whose word differs from the one ``d`` later."""
    end, step = len(words) - d, 16
    while i < end:
        stop = min(i + step, end)
        other = words[i:stop] != words[i + d : stop + d]
        k = int(other.argmax())
        if other[k]:
            return i + k
        i, step = stop, min(2 * step, 1 << 16)
    return end


def _since(words: np.ndarray, i: int, d: int) -> int:
    """The first of the places before ``i`` that all hold the word found ``d`` later."""
    step = 16
    while i > 0:
        start = max(0, i - step)
        other = words[start:i][::-1] != words[start + d : i + d][::-1]
        k = int(other.argmax())
        if other[k]:
            return i - k
        i, step = start, min(2 * step, 1 << 16)
    return 0


@lru_cache(maxsize=4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def _is_smallest(words: np.ndarray, start: int, d: int) -> bool:
    """Whether a stretch of period ``d``, at least twice as long, has no smaller one."""
    first = words[start : start + d]
    return not any((first == words[start + d // f : start + d // f + d]).all() for f in _prime_factors(d))


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period. ``words`` are numbers from 0."""
    n = len(words)
    if n < least:
        return []
    # how far on each pair of neighbouring words comes again
    pair = words[:-1] * (int(words.max()) + 1) + words[1:]
    order = np.argsort(pair, kind="stable")
    again = np.full(n - 1, 2 * n)
    same = pair[order[1:]] == pair[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: list[tuple[int, int, int]] = []
    for block, (lo, hi) in sorted(_scales(n, least).items()):
        count = (n - lo) // block
        if count < 1:
            continue
        if block > 1:
            reach = np.append(again, 0)[: count * block].reshape(count, block)[:, :-1].max(1)
            at = np.flatnonzero(reach <= hi) * block
        else:
            at = np.arange(count)
        if not len(at):
            continue
        place, distance = occurrences(words, at, block, lo, hi)
        known, until = np.ones(count, np.int64), np.full(count, -1)
        for s, length, q in found:
            if 2 * q <= hi:
                part = slice(-(-s // block), max(0, (s + length - max(lo, 2 * q) - block) // block + 1))
                known[part], until[part] = q, s + length
        at = place // block
        fresh = (_block_of(distance, least) == block) & ~((distance % known[at] == 0) & (place + distance + block <= until[at]))
        order = np.lexsort((place[fresh], distance[fresh]))
        last, done = 0, 0
        for i, d in zip(place[fresh][order].tolist(), distance[fresh][order].tolist()):
            if d != last:
                last, done = d, 0
            if i < done:
                continue
            done = _until(words, i, d)
            if done - i < block:
                continue  # a sum that is a multiple of the prime
            start = _since(words, i, d)
            length = done + d - start
            if length >= max(least, 2 * d) and _is_smallest(words, start, d):
                found.append((start, length, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run is cut back to its first period."""
    edges = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edges[s + q] += 1
        edges[s + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per row: the runs as ``(start, length, period)`` in words, and the
    text without the words that lie in a run after its first period, joined by one space.

    Words are divided by ASCII white space. Null and empty texts have no words and no runs. Repeated
    rows and null ids each give their row, an empty table none; other columns are ignored. Texts are
    looked at one at a time, with memory in proportion to the text.
    """
    if least < 2:
        raise ValueError("least must be at least 2")
    rows = docs.select(F.col(id_col).alias("__id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("__raw"))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(raw: bytes) -> tuple[int, list[dict], str]:
        words = raw.split()
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        runs = runs_of(ids, least)
        kept = [words[i] for i in np.flatnonzero(collapsed(len(words), runs))] if runs else words
        return len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept).decode("utf-8", "replace")

    def run(batches):
        for b in batches:
            for start, stop in _slices(b, 1, SLICE_BYTES):
                out = [one(raw.as_py()) for raw in b.column(1)[start:stop]]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), arrow, pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0)[start:stop], *arrays], names=["__id", "n_words", "runs", "collapsed"])

    schema = f"__id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
