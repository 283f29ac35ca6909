"""Gradient-boosted trees on binned features, for samples of bounded size."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth whose levels each split on the best (feature, bin) per node."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, smallest: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smallest = trees, depth, rate, bins, smallest

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin, self.model = np.full(len(y), self.start), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                chosen = self._best(binned, node, gradient, weight, 1 << level)
                splits.append(chosen)
                feature, cut = chosen[node].T
                node = 2 * node + (binned[np.arange(len(y)), feature] > cut)
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + 1)
            self.model.append((splits, value))
            margin += value[node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def _best(self, binned, node, gradient, weight, nodes: int) -> np.ndarray:
        """(feature, cut) of each node; without a gain, a cut that sends all one way."""
        best, out = np.full(nodes, 1e-9), np.tile([0, self.bins], (nodes, 1))
        for f in range(binned.shape[1]):
            at = node * self.bins + np.minimum(binned[:, f], self.bins - 1)
            g = np.bincount(at, gradient, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
            h = np.bincount(at, weight, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g ** 2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g ** 2 / (total_h + 1)
            gain[(h < self.smallest) | (total_h - h < self.smallest)] = -1
            cut = gain.argmax(axis=1)
            better = gain[np.arange(nodes), cut] > best
            best[better] = gain[np.arange(nodes), cut][better]
            out[better] = np.stack([np.full(nodes, f), cut], axis=1)[better]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        binned, margin = self._bin(x), np.full(len(x), self.start)
        for splits, value in self.model:
            node = np.zeros(len(x), np.int64)
            for chosen in splits:
                feature, cut = chosen[node].T
                node = 2 * node + (binned[np.arange(len(x)), feature] > cut)
            margin += value[node]
        return 1 / (1 + np.exp(-margin))
