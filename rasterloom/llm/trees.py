"""Gradient-boosted trees on histograms with monotonic constraints, as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees: a leaf has feature -1. ``roots`` holds each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches: all rows go one level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    found = []
    for column in x.T:
        marks = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        found.append(marks[marks < column.max()] if len(column) else marks)
    return found


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 48,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Forest:
    """Logistic boosting. ``monotone[f]`` is 1 or -1 where the score must not fall or rise with f.

    A split on such a feature needs its leaf values in that order, and their middle bounds all
    values below it. With one class only, the forest has no trees.
    """
    cuts = _cuts(x, bins)
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
    wide = max((len(c) for c in cuts), default=0) + 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    sign = np.array(monotone)[:, None]
    usable = np.array([[b < len(c) for b in range(wide)] for c in cuts])
    n_features = x.shape[1]
    shift = np.arange(n_features) * wide
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(x), base)

    def leaf(v: float) -> int:
        for held, new in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, v)):
            held.append(new)
        return len(feature) - 1

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        root = leaf(0.0)
        roots.append(root)
        open_nodes = [(root, np.arange(len(x)), -np.inf, np.inf, 0)]
        while open_nodes:
            node, rows, low, high, level = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = rate * float(np.clip(g / (h + ridge), low, high))
            if level < depth and h > 2 * least:
                keys = (binned[rows] + shift).ravel()
                gs = np.bincount(keys, np.repeat(grad[rows], n_features), n_features * wide)
                hs = np.bincount(keys, np.repeat(hess[rows], n_features), n_features * wide)
                gl = gs.reshape(n_features, wide).cumsum(1)
                hl = hs.reshape(n_features, wide).cumsum(1)
                wl = np.clip(gl / (hl + ridge), low, high)
                wr = np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                fits = usable & (hl >= least) & (h - hl >= least) & (sign * (wr - wl) >= 0)
                gain = np.where(fits, gain, 0)
                f, b = divmod(int(gain.argmax()), wide)
                if gain[f, b] > 1e-6:
                    middle = (wl[f, b] + wr[f, b]) / 2
                    down = binned[rows, f] <= b
                    kids = leaf(0.0), leaf(0.0)
                    feature[node], threshold[node] = f, float(cuts[f][b])
                    left[node], right[node] = kids
                    for kid, own, first in ((kids[0], rows[down], True), (kids[1], rows[~down], False)):
                        side = monotone[f] * (1 if first else -1)
                        bounds = (low, middle) if side > 0 else (middle, high) if side < 0 else (low, high)
                        open_nodes.append((kid, own, *bounds, level + 1))
                    continue
            margin[rows] += value[node]
    arrays = [np.array(a, t) for a, t in ((feature, int), (threshold, float), (left, int), (right, int), (value, float), (roots, int))]
    return Forest(*arrays, base=base, depth=depth)
