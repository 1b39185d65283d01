"""A random forest on binned features, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Complete trees: node i's children are 2i + 1 and 2i + 2; ``leaf`` holds shares of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf) or not len(x):
            return np.full(len(x), self.prior)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total / len(self.leaf)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 7, seed: int = 7) -> Forest:
    """Each tree sees a bootstrap of the rows and, at each node, a third of the features."""
    inner, leaves = 2**depth - 1, 2**depth
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return empty
    rng = np.random.default_rng(seed)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    at = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) + np.arange(m) * BINS
    some = max(1, m // 3)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        weight = rng.multinomial(n, np.full(n, 1 / n)).astype(float)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, start = 2**level, 2**level - 1
            cell = ((node - start)[:, None] * (m * BINS) + at).ravel()
            shape = (width, m, BINS)
            w = np.bincount(cell, np.repeat(weight, m), width * m * BINS).reshape(shape).cumsum(axis=2)
            p = np.bincount(cell, np.repeat(weight * y, m), width * m * BINS).reshape(shape).cumsum(axis=2)
            w_all, p_all = w[:, :, -1:], p[:, :, -1:]
            with np.errstate(invalid="ignore", divide="ignore"):
                purity = np.nan_to_num(p**2 / w + (w - p) ** 2 / w) + np.nan_to_num((p_all - p) ** 2 / (w_all - w) + (w_all - w - p_all + p) ** 2 / (w_all - w))
                whole = np.nan_to_num(p_all**2 / w_all + (w_all - p_all) ** 2 / w_all)
            gain = purity - whole
            gain[(w < 2) | (w_all - w < 2)] = -1
            for j in range(width):
                allowed = rng.choice(m, some, replace=False)
                f, b = divmod(int(gain[j, allowed].argmax()), BINS)
                f = int(allowed[f])
                if gain[j, f, b] > 1e-9 and b < len(edges[f]):
                    feature[start + j], threshold[start + j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        end = node - inner
        w, p = np.bincount(end, weight, leaves), np.bincount(end, weight * y, leaves)
        features.append(feature)
        thresholds.append(threshold)
        values.append((p + empty.prior) / (w + 1))
    return Forest(np.array(features), np.array(thresholds), np.array(values), empty.prior)
