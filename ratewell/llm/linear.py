"""Logistic regression on the driver, for bounded training samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Rows:
    """Rows of present features (binary) and a few dense columns."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int, features: int, dense: np.ndarray | None = None):
        self.row, self.feature, self.n, self.features = row, feature, n, features
        self.dense = np.zeros((n, 0)) if dense is None else dense

    def take(self, mask: np.ndarray) -> Rows:
        place = np.cumsum(mask) - 1
        keep = mask[self.row]
        return Rows(place[self.row[keep]], self.feature[keep], int(mask.sum()), self.features, self.dense[mask])

    def with_dense(self, dense: np.ndarray) -> Rows:
        return Rows(self.row, self.feature, self.n, self.features, dense)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], minlength=self.n) + self.dense @ w[self.features : -1] + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, g[self.row], minlength=self.features), self.dense.T @ g, [g.sum()]])


def fit(x: Rows, y: np.ndarray, l2: float | np.ndarray = 1.0, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Weights of features, dense columns and intercept, by limited-memory quasi-Newton steps (L-BFGS)."""
    y = y.astype(float)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w = np.zeros(x.features + x.dense.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(len(w), 1e-6)
    penalty[:-1] = l2

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w)
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum()), x.back(sigmoid(z) - y) + penalty * w

    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, used = gradient.copy(), []
        for s, g, r in reversed(past):
            a = r * (s @ q)
            used.append(a)
            q -= a * g
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(gradient).max())
        for (s, g, r), a in zip(past, reversed(used), strict=True):
            q += s * (a - r * (g @ q))
        slope, size = -(gradient @ q), 1.0
        while True:
            new = w - size * q
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        step, change, gain = new - w, new_gradient - gradient, value - new_value
        w, value, gradient = new, new_value, new_gradient
        if step @ change > 1e-12:
            past = [*past[-memory + 1 :], (step, change, 1 / (step @ change))]
        if gain < 1e-6 * max(1.0, abs(value)):
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest F1, halfway to the next score; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    k = int(f1.argmax())
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)
