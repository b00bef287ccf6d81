"""Gradient-boosted trees with a logistic loss, on histograms, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete binary trees of one depth; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, smooth: float = 4.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)])
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.offset = float(np.log(prior / (1 - prior)))
        score = np.full(n, self.offset)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, nodes = (1 << level) - 1, 1 << level
                best = np.full(nodes, 1e-6)
                choice = np.zeros((nodes, 2), np.int64) - 1
                for f in range(width):
                    m = len(self.edges[f]) + 1
                    cell = (at - first) * m + binned[:, f]
                    gs = np.bincount(cell, g, nodes * m).reshape(nodes, m).cumsum(axis=1)
                    hs = np.bincount(cell, h, nodes * m).reshape(nodes, m).cumsum(axis=1)
                    left, right = gs[:, :-1] ** 2 / (hs[:, :-1] + self.smooth), (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + self.smooth)
                    if m < 2:
                        continue
                    gain = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + self.smooth)
                    k = gain.argmax(axis=1)
                    won = gain[np.arange(nodes), k] > best
                    best[won] = gain[np.arange(nodes), k][won]
                    choice[won] = np.column_stack([np.full(nodes, f), k])[won]
                for node, (f, k) in enumerate(choice.tolist()):
                    if f >= 0:
                        self.feature[t, first + node], self.cut[t, first + node] = f, self.edges[f][k]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            leaf = at - inner
            self.leaf[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.smooth)
            score += self.leaf[t, leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        score, rows = np.full(len(x), self.offset), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += leaf[at - len(feature)]
        return score
