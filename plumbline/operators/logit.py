"""Logistic regression by Newton steps: a few passes over the rows, to the precision of doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from plumbline.functions.columns import c
from plumbline.operators.svm import RowSums

# Steps at most, and step lengths tried if a whole step is no gain.
MOST_STEPS = 100
_LENGTHS = tuple(0.5**i for i in range(1, 45))
# A step that promises no more than this share of the loss is the last: its error is of the square of that.
_CLOSE = 1e-10


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, margin) - y * margin).sum())


def fit_logistic(df: DataFrame, penalty: float, features: str = "features", label: str = "label") -> np.ndarray:
    """Weights and, last, the intercept that minimise penalty/2 · |w|² + mean loss; the intercept is not penalised.

    A task holds one matrix of the squared number of features. Features are scaled by their own
    curvature when a step is solved for, so their units may differ much.
    """
    over = RowSums(df, features, c(label))
    width = over.width
    side = width + 1
    ridge = penalty * np.append(np.ones(width), 0.0)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            margin = z @ w
            p = 0.5 * (1 + np.tanh(margin / 2))
            return np.concatenate([[_loss(margin, y)], (p - y) @ z, (z.T @ (z * (p * (1 - p))[:, None])).ravel()])

        found = over.sum(part, 1 + side + side * side)
        return found[0] + 0.5 * ridge @ (w * w), found[1:side + 1] + ridge * w, found[side + 1:].reshape(side, side) + np.diag(ridge)

    def along(w: np.ndarray, step: np.ndarray) -> list[float]:
        def part(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            margin, more = z @ w, z @ step
            return np.array([_loss(margin + t * more, y) for t in _LENGTHS])

        return [v + 0.5 * ridge @ ((w + t * step) ** 2) for t, v in zip(_LENGTHS, over.sum(part, len(_LENGTHS)))]

    w = np.zeros(side)
    value, gradient, curve = at(w)
    for _ in range(MOST_STEPS):
        scale = 1 / np.sqrt(np.maximum(np.diag(curve), np.finfo(float).tiny))
        step = -scale * np.linalg.lstsq(scale[:, None] * curve * scale, scale * gradient, rcond=1e-14)[0]
        gain = -(gradient @ step)
        if gain <= _CLOSE * value:
            return w + step
        new = at(w + step)
        if new[0] > value - 1e-4 * gain:
            tried = along(w, step)
            step = _LENGTHS[int(np.argmin(tried))] * step
            new = at(w + step)
        w, (value, gradient, curve) = w + step, new
    raise RuntimeError(f"logistic loss not minimised in {MOST_STEPS} steps")
