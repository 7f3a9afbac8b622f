"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boost:
    """Logistic loss, depth-limited trees of equal depth stored as arrays."""

    def __init__(self, rounds: int = 80, depth: int = 5, rate: float = 0.25, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        """Train on features x and labels y (0 or 1)."""
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        b, (n, f) = self._bin(x), x.shape
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        offset = b + np.arange(f) * BINS
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            where = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS, np.int64)
            for level in range(self.depth):
                width = 2**level
                slot = (where[:, None] * f * BINS + offset).ravel()
                g = np.bincount(slot, np.repeat(grad, f), width * f * BINS).reshape(width, f, BINS)
                h = np.bincount(slot, np.repeat(hess, f), width * f * BINS).reshape(width, f, BINS)
                gl, hl = g.cumsum(2), h.cumsum(2)
                ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                gain[(hl < self.least) | (ha - hl < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                first = width - 1
                feature[first : first + width] = best // BINS
                cut[first : first + width] = np.where(good, best % BINS, BINS)
                where = where * 2 + (b[np.arange(n), feature[first + where]] > cut[first + where])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(where, grad, leaves) / (np.bincount(where, hess, leaves) + self.ridge)
            score += value[where]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        b = self._bin(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + where
                where = where * 2 + (b[rows, feature[at]] > cut[at])
            score += value[where]
        return 1 / (1 + np.exp(-score))
