"""Gradient-boosted trees for a binary label and isotonic calibration, in numpy on small samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: (trees, inner nodes) features and cuts, (trees, leaves) values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**depth - 1)]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0
) -> Trees:
    """Second-order boosting of the logistic loss over quantile histograms. Deterministic."""
    n, width = x.shape
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((rounds, inner), dtype=np.int64)
    cut = np.full((rounds, inner), np.inf)
    value = np.zeros((rounds, leaves))
    score, rows = np.full(n, base), np.arange(n)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for d in range(depth):
            first, wide = 2**d - 1, 2**d
            local = node - first
            best = np.full(wide, 1e-9)
            for j in range(width):
                key = local * bins + codes[:, j]
                gs = np.bincount(key, g, wide * bins).reshape(wide, bins).cumsum(axis=1)
                hs = np.bincount(key, h, wide * bins).reshape(wide, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                better = gain[np.arange(wide), k] > best
                best = np.where(better, gain[np.arange(wide), k], best)
                feature[t, first : first + wide][better] = j
                cut[t, first : first + wide][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        at = node - inner
        value[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        score += value[t, at]
    return Trees(base, feature, cut, value)


@dataclass
class Isotonic:
    """A non-decreasing step function with linear interpolation between its blocks."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.to)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over the distinct raw scores."""
    at, inverse, n = np.unique(raw, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, y, len(at))
    blocks: list[list[float]] = []  # label sum, weight, weighted position sum
    for a, s, w in zip(at, total, n, strict=True):
        blocks.append([float(s), float(w), float(a * w)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return Isotonic(b[:, 2] / b[:, 1], b[:, 0] / b[:, 1])
