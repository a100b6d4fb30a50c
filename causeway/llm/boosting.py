"""Gradient-boosted trees for small tables: logistic loss, histogram splits, Newton leaves."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of a fixed depth; node ``k`` has the children ``2k + 1`` and ``2k + 2``."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    prior: float = 0.0
    model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = cuts
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        binned = self._binned(x)
        score = np.full(len(y), self.prior)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.model.append(tree)
            score += tree[2][self._leaf(tree, binned)]
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)  # no split: all go left
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.zeros(width)
            for j in range(binned.shape[1]):
                cell = (node - first) * self.bins + binned[:, j]
                g = np.bincount(cell, grad, width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                h = np.bincount(cell, hess, width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g ** 2 / (h + self.l2) + (g_all - g) ** 2 / (h_all - h + self.l2) - g_all ** 2 / (h_all + self.l2)
                gain[(h < 0.5) | (h_all - h < 0.5)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best + 1e-9
                best = np.where(better, gain[np.arange(width), at], best)
                feature[first:first + width][better], cut[first:first + width][better] = j, at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, cut, -self.rate * g / (h + self.l2)

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[np.arange(len(node)), tree[0][node]] > tree[1][node])
        return node - (2 ** self.depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.prior + sum((t[2][self._leaf(t, binned)] for t in self.model), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))
