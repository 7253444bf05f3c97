"""A logistic scorer over sparse features, fitted on the driver from a bounded sample of rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(columns: np.ndarray, values: np.ndarray, cuts: np.ndarray, targets: np.ndarray, size: int, weights: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 120, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows columns[cuts[i]:cuts[i+1]] with such values and targets from 0 to 1.

    Full-batch Adam on the logistic loss with an L2 penalty: the same rows give the same weights.
    """
    rows = np.repeat(np.arange(len(targets)), np.diff(cuts))
    each = np.ones(len(targets)) if weights is None else weights
    each = each / max(each.sum(), 1e-12)
    used, inner = np.unique(columns, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[inner], minlength=len(targets)) + b
        error = (sigmoid(z) - targets) * each
        g = np.append(np.bincount(inner, values * error[rows], minlength=len(used)) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(size, np.float32)
    out[used] = w
    return out, float(b)
