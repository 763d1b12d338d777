"""Small dense logistic models, fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 30) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(0) if len(x) else np.ones(x.shape[1])
        self.scale[self.scale < 1e-9] = 1.0
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = sigmoid(z @ w)
            gradient = z.T @ (weight * (p - y)) + penalty * w
            hessian = (z.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    s = score[order]
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    rank[order] = (first + last + 1) / 2
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n0 * n1)) if n0 and n1 else float("nan")
