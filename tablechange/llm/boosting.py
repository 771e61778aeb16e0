"""Gradient-boosted trees for two classes over a small, bounded sample."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Trees as nested tuples ``(feature, cut, left, right)``; a leaf is a number."""

    bias: float = 0.0
    trees: list = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> BoostedTrees:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        model = cls(math.log(share / (1 - share)))
        if not len(y):
            return model
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        z = np.full(len(y), model.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-9
            tree = _grow(binned, cuts, g, h, np.arange(len(y)), depth, rate, least, z)
            model.trees.append(tree)
        return model

    def margin(self, row: list[float]) -> float:
        z = self.bias
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            z += tree
        return z


def _grow(binned, cuts, g, h, rows, depth, rate, least, z):
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) > 1:
        base = total_g**2 / (total_h + least)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
            gain = left_g**2 / (left_h + least) + (total_g - left_g) ** 2 / (total_h - left_h + least) - base
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        leaf = float(rate * total_g / (total_h + least))
        z[rows] += leaf
        return leaf
    _, j, k = best
    goes = binned[rows, j] <= k
    return (j, float(cuts[j][k]), *(_grow(binned, cuts, g, h, part, depth - 1, rate, least, z) for part in (rows[goes], rows[~goes])))


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """``(a, b)`` such that ``sigmoid(a * margin + b)`` is calibrated on these rows."""
    a, b = 1.0, 0.0
    if not len(y):
        return a, b
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        e = p - target
        grad = np.array([(e * margins).sum(), e.sum()])
        hess = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(step[0]), b - float(step[1])
    return max(a, 1e-3), b
