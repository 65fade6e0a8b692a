"""Logistic calibration of a few features, fitted on the driver over a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.center) / self.scale, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> Logistic:
    """Newton steps on the ridge-regularised likelihood; rows of ``x`` against 0/1 ``y``."""
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(center, scale, w)
