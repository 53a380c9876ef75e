"""Gradient-boosted trees for a yes-or-no target, in numpy: logistic loss, second-order leaf weights, histogram splits."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, d = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        width = max(len(e) for e in self.edges) + 1
        p = float((w * y).sum() / w.sum())
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        size = 2**self.depth - 1
        self.feature, self.limit, self.leaf = np.zeros((self.trees, size), np.int64), np.full((self.trees, size), np.inf), np.zeros((self.trees, size + 1))
        shifted = code + np.arange(d) * width
        for t in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (q - y), w * q * (1 - q)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                nodes = 2**level
                key = (shifted + ((at - first) * d * width)[:, None]).reshape(-1)
                gs = np.bincount(key, np.repeat(g, d), nodes * d * width).reshape(nodes, d, width).cumsum(2)
                hs = np.bincount(key, np.repeat(h, d), nodes * d * width).reshape(nodes, d, width).cumsum(2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                flat = gain.reshape(nodes, -1)
                best = flat.argmax(1)
                feature, cut = best // width, best % width
                good = flat[np.arange(nodes), best] > 1e-6
                for k in range(nodes):
                    if good[k]:
                        self.feature[t, first + k] = feature[k]
                        self.limit[t, first + k] = self.edges[feature[k]][cut[k]]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.limit[t, at])
            at -= size
            gl, hl = np.bincount(at, g, size + 1), np.bincount(at, h, size + 1)
            self.leaf[t] = -self.rate * gl / (hl + self.ridge)
            f = f + self.leaf[t, at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        n = len(x)
        out = np.full(n, self.base)
        rows = np.arange(n)
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(n, np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - len(feature)]
        return out
