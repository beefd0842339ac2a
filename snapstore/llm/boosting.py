"""Gradient-boosted trees for a binary label over dense features, with isotonic calibration (NumPy)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Trees of fixed depth grown on binned features, Newton steps on the logistic loss."""

    trees: int = 120
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    l2: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # of each tree: features and bins, by node
    leaves: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for k in range(x.shape[1]):
            v = x[:, k]
            self.edges.append(np.unique(np.concatenate([np.quantile(v, q), np.quantile(v[v > v.min()], q)]) if (v > v.min()).any() else v[:1]))
        b = self.binned(x)
        width = max(len(e) for e in self.edges) + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            pr = sigmoid(margin)
            g, h = y - pr, pr * (1 - pr)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                for k in range(x.shape[1]):
                    at = (node - first) * width + b[:, k]
                    gs = np.cumsum(np.bincount(at, g, many * width).reshape(many, width), axis=1)
                    hs = np.cumsum(np.bincount(at, h, many * width).reshape(many, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(many), top]
                    better = value > best
                    best[better], feature[first : first + many][better], cut[first : first + many][better] = value[better], k, top[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            n = 2**self.depth
            values = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.l2)
            margin += values[leaf]
            self.splits.append((feature, cut))
            self.leaves.append(values)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for (feature, cut), values in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += values[node - (2**self.depth - 1)]
        return out


@dataclass
class Isotonic:
    """Pool-adjacent-violators fit, read by linear interpolation between the means of its blocks."""

    x: np.ndarray
    y: np.ndarray

    @staticmethod
    def fit(score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of scores, sum of labels, weight
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([s, float(v), 1.0])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                a = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
        return Isotonic(np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a trace of the score itself keeps the order inside flat parts."""
        return np.clip(0.999 * np.interp(score, self.x, self.y) + 0.001 * sigmoid(score), 0.0, 1.0)
