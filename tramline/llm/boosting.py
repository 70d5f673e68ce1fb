"""Small gradient-boosted trees for two classes, fitted on a bounded set of rows."""

from __future__ import annotations

import dataclasses

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclasses.dataclass
class Trees:
    """Full binary trees of one depth: split feature and limit per inner node, value per leaf."""

    base: float
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > limit[node])
            out += value[node - (2 ** self.depth - 1)]
        return out


def fit(rows: np.ndarray, truth: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2,
        ridge: float = 1.0, bins: int = 32) -> Trees:
    """Second-order boosting on quantile bins of the features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)])
    share = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(rows), base)
    inner = 2 ** depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    limit = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = sigmoid(score)
        slope, bend = truth - p, p * (1 - p)
        node = np.zeros(len(rows), dtype=np.int64)
        for n in range(inner):
            mine = np.flatnonzero(node == n)
            best = 1e-6
            if len(mine) > 1:
                g_all, h_all = slope[mine].sum(), bend[mine].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[f, mine]
                    g = np.cumsum(np.bincount(b, slope[mine], len(e) + 1))[:-1]
                    h = np.cumsum(np.bincount(b, bend[mine], len(e) + 1))[:-1]
                    gain = (g ** 2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge)
                            - g_all ** 2 / (h_all + ridge))
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[t, n], limit[t, n] = gain[i], f, e[i]
            node[mine] = 2 * n + 1 + (rows[mine, feature[t, n]] > limit[t, n])
        for leaf in range(inner + 1):
            mine = node == inner + leaf
            if mine.any():
                value[t, leaf] = rate * slope[mine].sum() / (bend[mine].sum() + ridge)
        score += value[t, node - inner]
    return Trees(base, depth, feature, limit, value)


def calibrated(score: np.ndarray, truth: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to probabilities (Newton's method)."""
    a, b = 1.0, 0.0
    hits = truth.sum()
    aim = np.where(truth > 0, (hits + 1) / (hits + 2), 1 / (len(truth) - hits + 2))
    for _ in range(steps):
        p = sigmoid(a * score + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - aim) * score).sum(), (p - aim).sum()])
        h = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()],
                      [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    return a, b
