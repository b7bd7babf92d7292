"""Logistic calibration of a few features, fitted by Newton steps on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) of P(y = 1 | x); a constant at the share of ones where there is nothing to tell apart."""
    a = np.hstack([np.asarray(x, float).reshape(len(y), -1), np.ones((len(y), 1))])
    y, w = np.asarray(y, float), np.zeros(a.shape[1])
    if not len(y):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.eye(len(w))
        penalty[-1, -1] = 1e-6
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).reshape(-1, len(w) - 1)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
