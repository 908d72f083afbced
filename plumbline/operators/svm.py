"""A linear support vector machine with a certificate of how close to the optimum it is.

The hinge loss is rounded off within a width that shrinks step by step, and each rounded problem is
solved by Newton steps of one pass over the rows. At its solution the rows' slopes are a point of the
dual problem, so every fit comes with a lower bound on the objective: the duality gap, which is at
most a quarter of the last width, and is measured, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.operators.gramian import tree_sum
from plumbline.session import materialise

# Widths of the rounding (the first so wide that all rows lie in it at the start), steps of each, the least gradient (relative) a step is taken for, and step lengths tried.
WIDTHS = (4.0, 1.0, 0.25, 0.06, 0.015, 4e-3, 1e-3, 3e-4)
MOST_STEPS = 60
GAP = 1e-4
_FLAT = 1e-9
_LENGTHS = tuple(0.5**i for i in range(1, 45))
# Most of the intercept's own curvature, for the case that no row lies in the rounded part, and its most as a share of the penalty: along
# one-hot columns that add up to the intercept only the penalty bends the loss, and a floor above it would make every step too short.
_FLOOR = 1e-6
_FLOOR_SHARE = 1e-3
_SLAB = 4096


@dataclass(frozen=True)
class SvmFit:
    """Weights and intercept, the objective there, the dual's value below it, and the passes taken."""

    weights: np.ndarray
    intercept: float
    primal: float
    dual: float
    passes: int

    @property
    def gap(self) -> float:
        return self.primal - self.dual


@dataclass(frozen=True)
class _State:
    smooth: float
    hinge: float
    slopes: np.ndarray  # of class -1 and +1: their sum, and their sum with the features
    curvature: np.ndarray


def _dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (indices, values, y) of a batch in slabs: a matrix whose last column is one, and y."""
    counts = np.diff(batch.column(0).offsets.to_numpy())
    index, value = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
    y = batch.column(2).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for at in range(0, len(y), _SLAB):
        n = len(y[at:at + _SLAB])
        part = slice(ends[at], ends[at + n])
        z = np.zeros((n, width + 1))
        z[:, width] = 1
        z[np.repeat(np.arange(n), counts[at:at + n]), index[part]] = value[part]
        yield z, y[at:at + n]


class RowSums:
    """Passes over rows (features, y): means of sums that tasks add up and a tree brings together.

    The rows are written once, by what is not zero in them, so that no pass has to find them again
    and one-hot columns do not travel.
    """

    def __init__(self, df: DataFrame, features: str, y: Column):
        first = df.select(c(features).alias("x")).first()
        if first is None:
            raise ValueError("no training rows")
        vector = F.unwrap_udt(c(features))
        # A vector without gaps is stored dense, without indices.
        indices = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
        rows = df.select(indices.alias("indices"), vector["values"].alias("values"), y.cast("double").alias("y"))
        self.rows, self.width, self.passes = materialise(rows, "training-rows"), first["x"].size, 0
        self.n = self.rows.count()

    def sum(self, part, size: int) -> np.ndarray:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for z, y in _dense(batch, width):
                    total += part(z, y)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        self.passes += 1
        found = tree_sum(self.rows.mapInArrow(run, "sums binary"))
        return np.zeros(size) if found is None else found / self.n


class _Rows(RowSums):
    def at(self, w: np.ndarray, width: float) -> _State:
        side = self.width + 1

        def part(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = 1 - y * (z @ w)
            a = np.clip(s / width, 0, 1)
            near = z[(s > 0) & (s < width)]
            slopes = [np.concatenate([[a[y == k].sum()], a[y == k] @ z[y == k]]) for k in (-1, 1)]
            return np.concatenate([[_rounded(s, width).sum(), np.maximum(s, 0).sum()], *slopes, (near.T @ near).ravel() / width])

        found = self.sum(part, 2 + 2 * (side + 1) + side * side)
        return _State(found[0], found[1], found[2:2 + 2 * (side + 1)].reshape(2, side + 1), found[-side * side:].reshape(side, side))

    def along(self, w: np.ndarray, step: np.ndarray, width: float) -> np.ndarray:
        """The rounded loss at each of the step lengths."""

        def part(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            s, d = 1 - y * (z @ w), y * (z @ step)
            return np.array([_rounded(s - t * d, width).sum() for t in _LENGTHS])

        return self.sum(part, len(_LENGTHS))


def _rounded(s: np.ndarray, width: float) -> np.ndarray:
    """Hinge loss of the slack, a parabola within the width."""
    return np.where(s >= width, s - width / 2, np.square(np.maximum(s, 0)) / (2 * width))


def _dual(state: _State, penalty: float) -> float:
    """Value of the dual at the rows' slopes, those of the heavier class scaled down so that both weigh alike."""
    (minus, plus) = (state.slopes[0, 0], state.slopes[1, 0])
    if not minus or not plus:
        return 0.0
    down, up = min(1.0, plus / minus), min(1.0, minus / plus)
    w = up * state.slopes[1, 1:-1] - down * state.slopes[0, 1:-1]
    return float(up * plus + down * minus - w @ w / (2 * penalty))


def fit_svm(
    df: DataFrame, penalty: float, features: str = "features", label: str = "label", widths: tuple[float, ...] = WIDTHS, gap: float = GAP,
) -> SvmFit:
    """Minimises penalty/2 · |w|² + mean hinge loss; labels are 0 and 1, the intercept is not penalised.

    Ends once the duality gap is at most ``gap`` (of the objective, if that is above one), or with the
    last width. A task holds one matrix of the squared number of features. A rounded problem that is
    not solved within the steps is an error.
    """
    over = _Rows(df, features, 2.0 * c(label) - 1)
    width = over.width
    w = np.zeros(width + 1)
    ridge = penalty * np.append(np.ones(width), 0.0)
    floor = np.append(np.zeros(width), min(_FLOOR, _FLOOR_SHARE * penalty))
    for rounding in widths:
        state = over.at(w, rounding)
        for _ in range(MOST_STEPS):
            pull = state.slopes[1, 1:] - state.slopes[0, 1:]
            gradient = ridge * w - pull
            if np.abs(gradient).max() <= _FLAT * max(1e-3, np.abs(pull).max(), np.abs(ridge * w).max()):
                break
            curve = state.curvature + np.diag(ridge + floor)
            step = -np.linalg.lstsq(curve, gradient, rcond=1e-14)[0]
            value = state.smooth + 0.5 * ridge @ (w * w)
            new = over.at(w + step, rounding)
            if new.smooth + 0.5 * ridge @ ((w + step) ** 2) > value + 1e-4 * gradient @ step:
                tried = over.along(w, step, rounding)
                values = [v + 0.5 * ridge @ ((w + t * step) ** 2) for t, v in zip(_LENGTHS, tried)]
                if min(values) >= value:
                    break  # as good as numbers can tell
                step = _LENGTHS[int(np.argmin(values))] * step
                new = over.at(w + step, rounding)
            w, state = w + step, new
        else:
            raise RuntimeError(f"hinge loss rounded to {rounding:g} not minimised in {MOST_STEPS} steps")
        found = SvmFit(w[:-1], float(w[-1]), float(state.hinge + 0.5 * ridge @ (w * w)), _dual(state, penalty), over.passes)
        if found.gap <= gap * max(1.0, found.primal):
            break
    return found
