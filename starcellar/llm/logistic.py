"""Logistic loss by Newton's method, over rows at hand or over sums made elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(features: np.ndarray, outcome: np.ndarray, ridge: float = 1e-3, weight: np.ndarray | None = None,
        steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method; ``ridge`` keeps them finite when the classes can be separated."""
    x, y = np.asarray(features, dtype=float), np.asarray(outcome, dtype=float)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)

    def slopes(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(x @ beta)
        return x.T @ (w * (y - p)), (x * (w * p * (1 - p))[:, None]).T @ x

    return newton(slopes, x.shape[1], ridge, steps)


def newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float, steps: int = 50) -> np.ndarray:
    """Coefficients where the loss is least; ``slopes`` gives its gradient and curvature, both without the ridge."""
    beta = np.zeros(size)
    for _ in range(steps):
        gradient, hessian = slopes(beta)
        step = np.linalg.solve(hessian + ridge * np.eye(size), gradient - ridge * beta)
        beta += step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta
