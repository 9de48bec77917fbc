"""Softmax boosting over binned features, for a bounded table in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64
RIDGE = 1e-6


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _histograms(xb: np.ndarray, node: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of ``weight`` by (node, feature, bin)."""
    n, f = xb.shape
    key = (node[:, None] * f + np.arange(f)) * BINS + xb
    return np.bincount(key.ravel(), np.repeat(weight, f), nodes * f * BINS).reshape(nodes, f, BINS)


@dataclass
class Boosted:
    """Complete trees of one depth, one a round and class: the feature and cut of each inner node, the value of each leaf."""

    start: np.ndarray
    feature: np.ndarray  # (rounds, classes, inner nodes)
    cut: np.ndarray      # go right above it
    value: np.ndarray    # (rounds, classes, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        rows = np.arange(len(x))
        inner = self.feature.shape[2]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            for k in range(out.shape[1]):
                node = np.zeros(len(x), np.int64)
                while len(node) and node[0] < inner:
                    node = 2 * node + 1 + (x[rows, feature[k][node]] > cut[k][node])
                out[:, k] += value[k][node - inner]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int, depth: int, step: float, subsample: float, leaf: int, seed: int) -> Boosted:
    """Trees on the gradients of the softmax, one a class and round; ``y`` holds class numbers from 0.

    Splits are sought between bins that hold equal shares of the rows; all features and nodes of a
    level come from the same histograms. A split needs ``leaf`` sampled rows on both sides; a node
    without one sends everything left.
    """
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    xb = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    cuts = np.full((x.shape[1], BINS), np.inf)
    for f, e in enumerate(edges):
        cuts[f, :len(e)] = e
    truth = np.eye(classes)[y]
    start = np.log(np.maximum(truth.mean(axis=0), 1e-9))
    margin = np.tile(start, (len(x), 1))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, cut = np.zeros((rounds, classes, inner), np.int64), np.full((rounds, classes, inner), np.inf)
    value = np.zeros((rounds, classes, leaves))
    for r in range(rounds):
        p = softmax(margin)
        some = rng.random(len(x)) < subsample if subsample < 1 else np.ones(len(x), bool)
        for k in range(classes):
            g, h = truth[:, k] - p[:, k], p[:, k] * (1 - p[:, k])
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                n, own = 2 ** level, node[some]
                left = [np.cumsum(_histograms(xb[some], own, w, n), axis=2) for w in (g[some], h[some], np.ones(some.sum()))]
                (gl, hl, nl), (gr, hr, nr) = left, [a[:, :, -1:] - a for a in left]
                gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE)
                whole = (gl + gr)[:, :, :1] ** 2 / ((hl + hr)[:, :, :1] + RIDGE)
                gain = np.where((nl >= leaf) & (nr >= leaf) & (gain > whole + 1e-12), gain, -np.inf).reshape(n, -1)
                best = gain.argmax(axis=1)
                good = np.isfinite(gain[np.arange(n), best])
                f, b = best // BINS, best % BINS
                at = slice(n - 1, 2 * n - 1)
                feature[r, k, at], cut[r, k, at] = f, np.where(good, cuts[f, b], np.inf)
                node = 2 * node + (good[node] & (xb[np.arange(len(x)), f[node]] > b[node]))
            own = node[some]
            total, curve = np.bincount(own, g[some], leaves), np.bincount(own, h[some], leaves)
            value[r, k] = step * (classes - 1) / classes * total / np.maximum(curve, RIDGE)
            margin[:, k] += value[r, k][node]
    return Boosted(start, feature, cut, value)


def fit_sigmoid(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (z, y), by Newton steps with a slight ridge."""
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
