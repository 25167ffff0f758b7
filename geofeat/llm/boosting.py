"""Gradient-boosted trees and isotonic calibration in numpy.

For dense features of a bounded training sample on one machine; scoring is a few
array operations a tree and runs inside Spark tasks. Log loss, second-order
leaves, histograms over quantile bins, complete trees of a fixed depth; no
randomness, so equal data give equal models.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    n_trees: int = 60
    depth: int = 3
    rate: float = 0.2
    n_bins: int = 32
    min_weight: float = 2.0
    penalty: float = 1.0
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.empty((0, 0), int))
    threshold: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    value: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """x: rows by features; y: 0 or 1. With one class only, every score is its share."""
        n, m = x.shape
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.threshold, self.value = np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.n_bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
        slots = (np.arange(m) * self.n_bins)[None, :] + binned
        margin = np.full(n, self.base)
        trees = []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                if len(rows):
                    feature[at], threshold[at] = self._split(slots[rows], grad[rows], hess[rows], edges, m)
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            leaf = node - inner
            sums = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
            value = self.rate * sums[0] / (sums[1] + self.penalty)
            margin += value[leaf]
            trees.append((feature, threshold, value))
        self.feature, self.threshold, self.value = (np.stack(a) for a in zip(*trees))
        return self

    def _split(self, slots, grad, hess, edges, m) -> tuple[int, float]:
        size = m * self.n_bins
        g = np.bincount(slots.ravel(), np.repeat(grad, m), size).reshape(m, -1).cumsum(1)
        h = np.bincount(slots.ravel(), np.repeat(hess, m), size).reshape(m, -1).cumsum(1)
        all_g, all_h = g[0, -1], h[0, -1]
        gain = g**2 / (h + self.penalty) + (all_g - g) ** 2 / (all_h - h + self.penalty) - all_g**2 / (all_h + self.penalty)
        gain[(h < self.min_weight * 0.25) | (all_h - h < self.min_weight * 0.25)] = -np.inf
        for j in range(m):
            gain[j, len(edges[j]) :] = -np.inf
        j, k = divmod(int(gain.argmax()), self.n_bins)
        return (j, float(edges[j][k])) if gain[j, k] > 1e-9 else (0, np.inf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


@dataclass
class Isotonic:
    """Least-squares monotone fit of labels on scores, by pooling adjacent violators; linear between its steps."""

    at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    p: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def fit(self, score: np.ndarray, y: np.ndarray) -> "Isotonic":
        if not len(score):
            return self
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest score
        for s, label in zip(score[order], y[order]):
            if blocks and blocks[-1][3] == s:
                blocks[-1][0] += label
                blocks[-1][1] += 1
            else:
                blocks.append([float(label), 1.0, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1][0] += last[0]
                blocks[-1][1] += last[1]
                blocks[-1][3] = last[3]
        self.at = np.array([x for b in blocks for x in (b[2], b[3])])
        self.p = np.array([p for b in blocks for p in [b[0] / b[1]] * 2])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.p)
