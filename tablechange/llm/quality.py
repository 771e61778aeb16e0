"""Quality of documents by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over bins of its values, and some pairs of features have one
over both. The tables are learned by cyclic boosting: round after round each feature in turn gets a
shallow tree on the gradients of what all tables say so far, added at a small rate, so that no feature
takes what another one explains as well. Then the pairs are ranked by how much a tree over both
features would still gain, and the best get tables in the same way. A score is the sum of one bin
of each table, looked up for a whole batch at once.

At most ``max_train`` labelled rows are learned from (those with the smallest hash of their id), and only
their features and labels reach the driver. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablechange.llm.bpe import _slices
from tablechange.session import discard, materialize

MAX_TRAIN, BINS, PAIRS = 20_000, 32, 8
SLICE_BYTES = 1 << 20

FEATURES = (
    "length", "words", "word_length", "long_words", "letters", "capitals", "digits", "marks", "signs", "beyond_ascii", "spaces",
    "lines", "line_length", "repeated_lines", "distinct_words", "commonest_word", "stutter", "distinct_triples",
    "bare_marks", "ends_in_signs", "ends_in_marks", "ends_of_sentences", "all_capitals",
)

_KIND = np.zeros(256, np.int64)  # 0 control characters
for kind, characters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256)), b" \t\n\v\f\r"), 1):
    _KIND[list(characters)] = kind
_SIGNS, _MARKS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~"), frozenset(b"!?")


def features_of(raw: bytes) -> list[float]:
    """The features of a text in UTF-8, in the order of ``FEATURES``. All but the first two are shares or
    means, and all are defined for empty texts."""
    n = len(raw)
    # counts of each byte, by pieces: a long text is not widened as a whole
    text = np.frombuffer(raw, np.uint8)
    counts = sum((np.bincount(text[at : at + (1 << 20)], minlength=256) for at in range(0, n, 1 << 20)), np.zeros(256, np.int64))
    kinds = np.bincount(_KIND, counts, 8)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    seen = max(1, n)
    many = max(1, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    triples = (ids[:-2] * many + ids[1:-1]) * many + ids[2:] if len(ids) < 1 << 20 else _mixed(ids)
    lasts = Counter(w[-1] for w in words)
    repeated = sum(c - 1 for c in Counter(lines).values())
    return [
        math.log1p(n), math.log1p(len(words)), float(sizes.sum()) / many, float((sizes > 20).sum()) / many,
        (kinds[1] + kinds[2] + kinds[6]) / seen, kinds[2] / max(1.0, kinds[1] + kinds[2]), kinds[3] / seen, kinds[4] / seen, kinds[5] / seen, kinds[6] / seen, kinds[7] / seen,
        math.log1p(len(lines)), n / max(1, len(lines)), repeated / max(1, len(lines)),
        len(number) / many, float(np.bincount(ids).max()) / many if len(ids) else 0.0, float((ids[1:] == ids[:-1]).sum()) / many,
        len(np.unique(triples)) / max(1, len(triples)),
        sum(c for w, c in zip(number, np.bincount(ids)) if not w.isalnum() and not any(x >= 128 or chr(x).isalnum() for x in w)) / many,
        sum(c for x, c in lasts.items() if x in _SIGNS) / many, sum(c for x, c in lasts.items() if x in _MARKS) / many, lasts[46] / many,
        sum(c for w, c in zip(number, np.bincount(ids)) if len(w) > 2 and w.isupper()) / many,
    ]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Hashes of three neighbours where their numbers don't fit in one."""
    u, odd = ids.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    return ((u[:-2] * odd + u[1:-1]) * odd + u[2:]) * odd


@dataclass
class AdditiveModel:
    """``bias`` plus a table per feature and per pair. ``cuts[j]`` are the upper ends of the bins of feature
    j; ``pair_cuts`` the coarser ones that tables of pairs use."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sums of the tables for rows of features."""
        z = np.full(len(x), self.bias)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(c, x[:, j], side="left")]
        used = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="left") for j in {j for p in self.pairs for j in p}}
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[used[i], used[j]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    out = []
    for column in x.T:
        values = np.unique(column)
        # few values: a bin for each; else quantiles. The last bin has no upper end.
        out.append(values[:-1] if len(values) <= bins else np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
    return out


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """What a tree over ordered bins says for each bin, from the bins' gradients and weights: the best cut is
    made, then the best one in either part, until there are ``leaves`` parts."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four parts: its gain over no cut, and what it says for each cell."""
    sums = [np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0))) for a in (g, h)]

    def parts(s):
        whole, rows, columns, corner = s[-1, -1], s[1:, -1:], s[-1:, 1:], s[1:, 1:]
        return [corner, rows - corner, columns - corner, whole - rows - columns + corner]

    gain = sum(_gain(a, b) for a, b in zip(parts(sums[0]), parts(sums[1])))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + 1.0)
    return float(gain[i, j] - _gain(g.sum(), h.sum())), out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS, rounds: int = 150, rate: float = 0.1) -> AdditiveModel:
    """A model for labels ``y`` (0 to 1) of rows ``x``. Without rows every score is one half."""
    if not len(y):
        return AdditiveModel(0.0)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(math.log(base / (1 - base)), _cuts(x, bins), pair_cuts=_cuts(x, 8))
    binned, coarse = _binned(x, model.cuts), _binned(x, model.pair_cuts)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    def grid(i, j, g):
        wide = len(model.pair_cuts[j]) + 1
        return np.bincount(coarse[:, i] * wide + coarse[:, j], g, (len(model.pair_cuts[i]) + 1) * wide).reshape(-1, wide)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                step = rate * _tree(*(np.bincount(binned[:, j], s, len(table)) for s in slopes()))
                table += step
                z += step[binned[:, j]]
    g, h = slopes()
    split = [j for j, c in enumerate(model.pair_cuts) if len(c)]
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(split, 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = rate * _quadrants(*(grid(i, j, s) for s in slopes()))[1]
            table += step
            z += step[coarse[:, i], coarse[:, j]]
    return model


def _feature_rows(batch: pa.RecordBatch, column: int):
    """Row ranges of a batch with their features, a bounded amount of text at a time."""
    for start, stop in _slices(batch, column, SLICE_BYTES):
        yield start, stop, np.array([features_of(raw.as_py()) for raw in batch.column(column)[start:stop]], float)


def _raw(text_col: str):
    return F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("__raw")


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN
) -> AdditiveModel:
    """A model from the labelled rows. Rows of ``labels`` without id or label are left out; several labels of
    an id count as their mean. Rows of ``docs`` that repeat an id each count. Without labelled rows
    every score is one half."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__y")).dropna()
    known = known.groupBy("__id").agg(F.avg("__y").alias("__y"))
    chosen = materialize(known.orderBy(F.xxhash64("__id"), "__id").limit(max_train), "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), _raw(text_col)).join(chosen, "__id").select("__id", "__y", "__raw")

    def run(batches):
        for b in batches:
            for start, stop, x in _feature_rows(b, 2):
                yield pa.RecordBatch.from_arrays([b.column(0)[start:stop], b.column(1)[start:stop], pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    facts = rows.mapInArrow(run, "id long, y double, x array<double>")
    # ids that many rows repeat must not pass the bound either
    data = facts.orderBy(F.xxhash64("id"), "id", "x").limit(max_train).collect()
    discard(chosen)
    return fit_additive(np.array([r["x"] for r in data], float).reshape(len(data), len(FEATURES)), np.array([r["y"] for r in data], float))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(id, score, predicted)`` for every row of ``docs``, repeated rows and null ids included.

    Only the whole text enters the score, which is higher for likelier good texts; null texts count as
    empty and get a score too. An empty table gives no rows; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for start, stop, x in _feature_rows(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0)[start:stop], pa.array(given.value.scores(x))], names=["__id", "score"])

    rows = docs.select(F.col(id_col).alias("__id"), _raw(text_col))
    scored = rows.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(F.col("__id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
