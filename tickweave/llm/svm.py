"""Linear hinge-loss models on bounded samples: dual coordinate descent, and a logistic reading of margins."""

from __future__ import annotations

import numpy as np


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, *, cost: float = 1.0, epochs: int = 15, seed: int = 5, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Minimise |w|^2 / 2 + cost * sum(hinge) over sparse rows (indices, values) with labels y of -1 or 1.

    Each step solves the dual problem for one row exactly, within its box; the last weight is the bias.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    upper = cost * (np.ones(len(rows)) if weights is None else weights)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            k, v = rows[i]
            slope = y[i] * (w[k] @ v + bias) - 1
            was = alpha[i]
            alpha[i] = min(max(was - slope / norms[i], 0.0), upper[i])
            if step := (alpha[i] - was) * y[i]:
                w[k] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def balance(y: np.ndarray) -> np.ndarray:
    """Weights that give both labels half of the total."""
    ones = max(1, int((y > 0).sum()))
    rest = max(1, len(y) - ones)
    return np.where(y > 0, len(y) / (2 * ones), len(y) / (2 * rest))


def logistic_fit(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps on labels drawn slightly together."""
    ones = (y > 0).sum()
    goal = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 2.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g = p - goal
        h = np.maximum(p * (1 - p), 1e-9)
        m = np.array([[h @ (margins * margins) + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(m, [g @ margins + 1e-3 * a, g.sum()])
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.1), b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
