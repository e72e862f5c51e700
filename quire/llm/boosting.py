"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy.

Both are fitted on the driver from a sample whose size the caller bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Trees:
    """Complete binary trees of one depth: split features and thresholds by node, values by leaf."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic loss, second-order leaves; splits on quantile bins, first best on ties."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(depth, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    # A feature that is zero in most rows still gets cuts among its other values.
    edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, 16), method="lower")])) if len(v := x[x[:, j] != 0, j]) else e for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), model.base)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(n_trees):
        p = sigmoid(raw)
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.full(width, 10**9)
            local = node - first
            for j, edge in enumerate(edges):
                if not len(edge):
                    continue
                n = len(edge) + 1
                flat = local * n + binned[:, j]
                gs = np.bincount(flat, g, width * n).reshape(width, n).cumsum(axis=1)
                hs = np.bincount(flat, h, width * n).reshape(width, n).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                at = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.nonzero(top > best)[0]:
                    best[k], cut[k] = top[k], at[k]
                    feature[first + k], threshold[first + k] = j, edge[at[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[local])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values for ``np.interp``."""
    knots, start = np.unique(score, return_inverse=True)
    weight = np.bincount(start).astype(float)
    mean = np.bincount(start, y) / weight
    blocks: list[list[float]] = []
    for i, (m, w) in enumerate(zip(mean, weight, strict=True)):
        blocks.append([m, w, i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, end = blocks.pop()
            m1, w1, begin, _ = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, begin, end]
    xs = np.array([knots[b[k]] for b in blocks for k in (2, 3)])
    return xs, np.array([b[0] for b in blocks for _ in range(2)])
