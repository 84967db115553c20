"""Gradient-boosted trees for two classes, trained in numpy on a bounded table.

Features are cut into at most 64 bins; trees grow level by level on histograms of the
gradients of the logistic loss, so that scoring a batch is a few array lookups.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 4.0, penalty: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.slope, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Rows of features and 0/1 labels; both classes must occur."""
        y = y.astype(np.float64)
        points = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], points)) for f in range(x.shape[1])]
        binned = self._binned(x)
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.rate * self._leaf(tree, binned)
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node (feature -1: all go left), and the leaves' values."""
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, np.int64)
        node = np.zeros(len(gradient), np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-9)
            for f in range(binned.shape[1]):
                at = local * width + binned[:, f]
                g = np.cumsum(np.bincount(at, gradient, count * width).reshape(count, width), axis=1)
                h = np.cumsum(np.bincount(at, weight, count * width).reshape(count, width), axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.penalty) + (gt - g) ** 2 / (ht - h + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                k = gain.argmax(axis=1)
                value = gain[np.arange(count), k]
                better = value > best
                best[better] = value[better]
                feature[first + np.flatnonzero(better)] = f
                cut[first + np.flatnonzero(better)] = k[better]
            node = 2 * node + 1 + self._goes_right(feature[node], cut[node], binned)
        leaf = node - inner
        g = np.bincount(leaf, gradient, 2**self.depth)
        h = np.bincount(leaf, weight, 2**self.depth)
        return feature, cut, g / (h + self.penalty)

    @staticmethod
    def _goes_right(feature: np.ndarray, cut: np.ndarray, binned: np.ndarray) -> np.ndarray:
        return (feature >= 0) & (binned[np.arange(len(binned)), np.maximum(feature, 0)] > cut)

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + self._goes_right(feature[node], cut[node], binned)
        return value[node - (2**self.depth - 1)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if len(x):
            binned = self._binned(x)
            for tree in self.trees:
                score += self.rate * self._leaf(tree, binned)
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> BoostedTrees:
        """Fit a slope and a shift of the raw score on rows that the trees have not seen (Platt)."""
        s, y = self.raw(x), y.astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            ga, gb = ((p - y) * s).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b
            haa, hab, hbb = (w * s * s).sum() + 1e-3, (w * s).sum(), w.sum() + 1e-3
            det = haa * hbb - hab * hab
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
            a = min(max(a, 0.05), 20.0)
            b = min(max(b, -20.0), 20.0)
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
