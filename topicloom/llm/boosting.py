"""Gradient boosted trees with a logistic loss, small enough to be fitted on the driver and sent with tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of fixed depth over binned features; ``predict`` gives probabilities."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b, n = self._binned(x), len(y)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            split_on, split_at = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                for k in range(width):
                    rows = np.flatnonzero(node == k)
                    best = 1e-6
                    if len(rows) < 8:
                        continue
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(b.shape[1]):
                        gj = np.cumsum(np.bincount(b[rows, j], g[rows], self.bins))[:-1]
                        hj = np.cumsum(np.bincount(b[rows, j], h[rows], self.bins))[:-1]
                        gain = gj**2 / (hj + self.ridge) + (gs - gj) ** 2 / (hs - hj + self.ridge) - gs**2 / (hs + self.ridge)
                        at = int(gain.argmax())
                        if gain[at] > best:
                            best, split_on[first + k], split_at[first + k] = gain[at], j, at
                node = 2 * node + (b[np.arange(n), split_on[first + node]] > split_at[first + node])
            leaves = 2**self.depth
            values = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((split_on, split_at, values))
            z += values[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, rows = self._binned(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for on, at, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                node = 2 * node + (b[rows, on[first + node]] > at[first + node])
            z += values[node]
        return 1 / (1 + np.exp(-z))


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, shares): the non-decreasing shares of y that fit best, by pooling neighbours that are out of order."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for x, t in zip(scores[order], y[order], strict=True):
        pools.append([float(t), 1.0, float(x)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, n, _ = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += n
            pools[-1][2] = float(x)
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])
