"""Gradient-boosted trees with logistic loss on binned features, and isotonic calibration (numpy)."""

from __future__ import annotations

import numpy as np

BINS = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Boosted:
    """Complete trees of one depth, kept as arrays: a feature and a threshold for each inner node, a value for each leaf."""

    def __init__(self, trees: int = 150, depth: int = 3, rate: float = 0.1, least: float = 1.0, ridge: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.base = 0.0
        self.feature = np.zeros((0, (1 << depth) - 1), dtype=np.int64)
        self.cut = np.zeros((0, (1 << depth) - 1))
        self.value = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        share = np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(n, self.base)
        feature, cut, value = [], [], []
        for _ in range(self.trees):
            p = _sigmoid(f)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            tf, tc = np.zeros((1 << self.depth) - 1, dtype=np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                m, at = 1 << level, (1 << level) - 1
                best = np.full(m, 1e-6)
                pick = np.full((m, 2), -1, dtype=np.int64)
                for j in range(k):
                    key = node * BINS + binned[:, j]
                    gs = np.bincount(key, g, m * BINS).reshape(m, BINS).cumsum(axis=1)
                    hs = np.bincount(key, h, m * BINS).reshape(m, BINS).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    b = gain.argmax(axis=1)
                    v = gain[np.arange(m), b]
                    better = v > best
                    best[better] = v[better]
                    pick[better, 0], pick[better, 1] = j, b[better]
                go = np.zeros(n, dtype=np.int64)
                for q in range(m):
                    if pick[q, 0] >= 0:
                        tf[at + q], tc[at + q] = pick[q, 0], cuts[pick[q, 0]][pick[q, 1]]
                        mine = node == q
                        go[mine] = binned[mine, pick[q, 0]] > pick[q, 1]
                node = 2 * node + go
            gs, hs = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            v = self.rate * gs / (hs + self.ridge)
            f += v[node]
            feature.append(tf)
            cut.append(tc)
            value.append(v)
        self.feature, self.cut, self.value = np.array(feature), np.array(cut), np.array(value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        row = np.arange(len(x))
        for tf, tc, tv in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, tf[node]] > tc[node])
            f += tv[node - ((1 << self.depth) - 1)]
        return f


class Isotonic:
    """The non-decreasing step-wise fit of labels to scores (pool adjacent violators), interpolated between steps."""

    def __init__(self) -> None:
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(score):
            return self
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean of labels, weight, sum of scores
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, t = blocks.pop()
                a = blocks[-1]
                a[0] = (a[0] * a[1] + m * w) / (a[1] + w)
                a[1] += w
                a[2] += t
        self.x = np.array([t / w for _, w, t in blocks])
        self.y = np.array([m for m, _, _ in blocks])
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
