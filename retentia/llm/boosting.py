"""Gradient-boosted trees for a binary label, on a bounded table of numbers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Rows that all trees see at a time.
ROWS = 4096


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: inner node k goes to 2k + 1, or to 2k + 2 where the feature exceeds the cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # of the leaves, from left to right

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        inner = len(self.feature)
        while len(x) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.cut[node])
        return self.value[node - inner] if len(x) else np.zeros(0)


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: list[Tree]

    @cached_property
    def stacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, cuts and values, a row a tree; a shallow tree's leaves stand at the depth of the deepest."""
        inner = max(len(t.feature) for t in self.trees)
        feature, cut = np.zeros((len(self.trees), inner), np.int64), np.full((len(self.trees), inner), np.inf)
        value = np.zeros((len(self.trees), inner + 1))
        for k, t in enumerate(self.trees):
            feature[k, :len(t.feature)], cut[k, :len(t.cut)] = t.feature, t.cut
            value[k] = np.repeat(t.value, (inner + 1) // len(t.value))
        return feature, cut, value

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; a small table costs a few steps for all trees together, not some for each."""
        out = np.full(len(x), self.base, np.float64)
        if not self.trees:
            return out
        feature, cut, value = self.stacked
        inner = feature.shape[1]
        tree, leaf = np.arange(len(self.trees))[:, None] * inner, np.arange(len(self.trees))[:, None] * (inner + 1)
        for lo in range(0, len(x), ROWS):
            some = np.ascontiguousarray(x[lo:lo + ROWS])
            row = np.arange(len(some)) * x.shape[1]
            node = np.zeros((len(self.trees), len(some)), np.int64)
            for _ in range(inner.bit_length()):
                at = tree + node
                node = 2 * node + 1 + (some.take(row + feature.take(at)) > cut.take(at))
            out[lo:lo + ROWS] += value.take(leaf + node - inner).cumsum(axis=0)[-1]  # tree after tree, so that rounding is the same for any number of rows
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
        """Second-order boosting of the logistic loss on histograms of ``bins`` quantiles a feature."""
        if not len(y):
            return cls(0.0, [])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
        f_all, grown = np.full(len(y), base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f_all))
            g, h = y - p, p * (1 - p)
            inner = (1 << depth) - 1
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-9)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    at = (node - first) * (len(c) + 1) + code[:, f]
                    gs = np.bincount(at, g, width * (len(c) + 1)).reshape(width, -1).cumsum(axis=1)
                    hs = np.bincount(at, h, width * (len(c) + 1)).reshape(width, -1).cumsum(axis=1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    for n in np.flatnonzero(top > best):
                        best[n], feature[first + n], cut[first + n] = top[n], f, c[k[n]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            grown.append(Tree(feature, cut, value))
            f_all += value[leaf]
        return cls(base, grown)
