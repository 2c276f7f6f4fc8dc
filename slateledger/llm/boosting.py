"""Gradient-boosted trees over dense features, and isotonic calibration; fitted in memory."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting with trees of equal depth over binned features."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, l2: float = 2.0, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base, self.splits, self.leaves = 0.0, [], []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.r_[np.quantile(c, q), np.quantile(c[c > c.min()], q) if (c > c.min()).any() else []]) for c in x.T]
        b, width = self.binned(x), 2 * self.bins + 2
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                n, gain = 1 << level, []
                for k in range(b.shape[1]):
                    at = node * width + b[:, k]
                    g, h, c = (np.bincount(at, w, n * width).reshape(n, width).cumsum(axis=1) for w in (grad, hess, np.ones(len(y))))
                    left, right = g**2 / (h + self.l2), (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.l2)
                    gain.append(np.where((c >= self.least) & (c[:, -1:] - c >= self.least), left + right, -1.0))
                gain = np.stack(gain, axis=1).reshape(n, -1)
                best = gain.argmax(axis=1)
                best = np.where(gain.max(axis=1) > 0, best, width - 1)  # no split: all go left
                feature.append(best // width)
                cut.append(best % width)
                node = 2 * node + (b[np.arange(len(y)), feature[-1][node]] > cut[-1][node])
            g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
            leaf = self.rate * g / (h + self.l2)
            margin += leaf[node]
            self.splits.append((feature, cut))
            self.leaves.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, row = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for (feature, cut), leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + (b[row, f[node]] > c[node])
            out += leaf[node]
        return out


class Isotonic:
    """Pool-adjacent-violators over margins; between the pools' means the score is interpolated."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []
        for m, v in zip(margin[order], y[order].astype(float), strict=True):
            pools.append([m, v, 1.0])
            while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
                m2, v2, n2 = pools.pop()
                m1, v1, n1 = pools.pop()
                pools.append([(m1 * n1 + m2 * n2) / (n1 + n2), (v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
        self.at = np.array([p[0] for p in pools])
        self.value = np.array([(p[1] * p[2] + 0.05) / (p[2] + 0.1) for p in pools])
        self.value = np.maximum.accumulate(self.value)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value) + 1e-6 * np.tanh(margin / 10), 0.0, 1.0)
