"""Kernel PCA outliers: rows a radial-basis PCA rebuilds badly, by the kernel itself and with a certificate.

The kernel is smooth, so few of its columns span it: landmark rows are chosen one after the other
where the kernel of the rows so far explains least (a pivoted Cholesky factorisation whose pivots are
searched over all rows), until no row is left with more than a tolerance. Thinned rows propose most
landmarks, one pass over all rows finds what these leave, and only such rows are read again. What rows
keep unexplained is summed over every row, and the mean bounds the error of every component's variance.
The number of landmarks follows the kernel and the tolerance, not the number of rows.
Random Fourier features are an option for designs whose kernel no few landmarks span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.functions.columns import c
from plumbline.operators.gramian import gram_sums, matrix
from plumbline.operators.quantiles import number, quantiles
from plumbline.operators.split import in_share
from plumbline.session import materialise

# Seed of the sample and of the random features; what a row may keep unexplained.
SAMPLE_SEED = 912
FEATURES = 1024
TOLERANCE = 1e-8
# Most landmarks, which tasks and the driver hold with their square; candidates of a task and of a round.
MOST_LANDMARKS = 2048
_FROM_TASK = 64
_POOL = 1024
_SLAB = 1000
# One point in so many, by hash, proposes the first landmarks.
_THIN = 16


def fourier_features(width: int, gamma: float, features: int = FEATURES) -> Callable[[np.ndarray], np.ndarray]:
    """A map of rows whose inner products are close to exp(-gamma · squared distance)."""
    rng = np.random.default_rng(SAMPLE_SEED)
    turn = rng.standard_normal((width, features // 2)) * np.sqrt(2 * gamma)

    def apply(x: np.ndarray) -> np.ndarray:
        phase = x @ turn
        return np.concatenate([np.cos(phase), np.sin(phase)], axis=1) / np.sqrt(features // 2)

    return apply


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma · squared distance) of all rows of ``x`` and ``y``."""
    d = 2 * x @ y.T
    d -= (x * x).sum(axis=1)[:, None]
    d -= (y * y).sum(axis=1)
    np.minimum(d, 0, out=d)
    d *= gamma
    return np.exp(d, out=d)


def lower_inverse(low: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by halves.

    It takes products only: ``np.linalg.inv`` of some 110 to 126 rows never returned in a process that
    had forked, as a driver does to start its JVM, where OpenBLAS has several threads.
    """
    n, out = len(low), np.zeros_like(low)
    if n < 2:
        return 1 / low
    h = n // 2
    out[:h, :h], out[h:, h:] = lower_inverse(low[:h, :h]), lower_inverse(low[h:, h:])
    out[h:, :h] = -out[h:, h:] @ (low[h:, :h] @ out[:h, :h])
    return out


@dataclass(frozen=True)
class Landmarks:
    """Rows that span the kernel, and the inverse of their kernel's Cholesky factor."""

    rows: np.ndarray
    inverse: np.ndarray
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features whose inner products are the kernel of ``x`` as far as the landmarks explain it."""
        return kernel(x, self.rows, self.gamma) @ self.inverse.T if len(self.rows) else np.zeros((len(x), 0))

    def along(self, x: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """The features along the columns of ``axes`` only, which spares the others."""
        return kernel(x, self.rows, self.gamma) @ (self.inverse.T @ axes) if len(self.rows) else np.zeros((len(x), axes.shape[1]))

    def unexplained(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(1 - (self(x) ** 2).sum(axis=1), 0)

    def with_rows(self, more: np.ndarray) -> Landmarks:
        rows = np.concatenate([self.rows, more])
        k = kernel(rows, rows, self.gamma) + 1e-14 * np.eye(len(rows))
        return Landmarks(rows, lower_inverse(np.linalg.cholesky(k)), self.gamma)


def pivots(x: np.ndarray, known: Landmarks, most: int, tolerance: float) -> list[int]:
    """Rows of ``x`` that explain the others, the least explained one first, until all are within the tolerance."""
    left = known.unexplained(x)
    base, steps, chosen = known(x), np.zeros((len(x), 0)), []
    while len(chosen) < min(most, len(x)):
        i = int(left.argmax())
        if left[i] <= tolerance:
            break
        column = kernel(x, x[i:i + 1], known.gamma)[:, 0] - base @ base[i] - steps @ steps[i]
        column /= np.sqrt(left[i])
        steps = np.column_stack([steps, column])
        left = np.maximum(left - column**2, 0)
        left[i] = 0
        chosen.append(i)
    return chosen


def _left(rows: DataFrame, known: Landmarks, tolerance: float) -> DataFrame:
    """``(x, left)``: rows of which the landmarks leave more than the tolerance."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, known.rows.shape[1]))
            left = np.concatenate([np.empty(0), *[known.unexplained(x[at:at + _SLAB]) for at in range(0, len(x), _SLAB)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left)], names=["x", "left"]).filter(pa.array(left > tolerance))

    return materialise(rows.select("x").mapInArrow(keep, "x array<double>, left double"), "kernel-left")


def _offers(rows: DataFrame, known: Landmarks, room: int, tolerance: float) -> np.ndarray:
    """Pivots that the tasks find among ``rows``, the least explained ones."""
    width = known.rows.shape[1]

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else held[:0]
            for at in range(0, len(x), _SLAB):
                part = np.unique(np.concatenate([held, x[at:at + _SLAB]]), axis=0)
                held = part[pivots(part, known, room, tolerance)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.tolist() for r in held], pa.list_(pa.float64())), pa.array(known.unexplained(held))], names=["x", "left"])

    offered = rows.select("x").mapInArrow(offer, "x array<double>, left double")
    return np.array([r["x"] for r in offered.orderBy(F.col("left").desc(), "x").limit(_POOL).collect()]).reshape(-1, width)


def _explain(rows: DataFrame, known: Landmarks, tolerance: float, most: int) -> tuple[Landmarks, float]:
    """More landmarks, until no row is left or there are ``most``, and what any row keeps unexplained at most.

    What is within the tolerance stays so, thus each round reads only the rows that the last one left.
    """
    while True:
        rows = _left(rows, known, tolerance)
        worst = rows.agg(F.max("left")).first()[0] or 0.0
        pool = _offers(rows, known, min(_FROM_TASK, most - len(known.rows)), tolerance) if worst and len(known.rows) < most else []
        new = pivots(pool, known, min(_POOL, most - len(known.rows)), tolerance) if len(pool) else []
        if not new:
            return known, max(worst, tolerance)
        known = known.with_rows(pool[new])


def find_landmarks(rows: DataFrame, width: int, gamma: float, tolerance: float = TOLERANCE, most: int = MOST_LANDMARKS) -> tuple[Landmarks, float]:
    """Landmarks, and a bound on the share of a row's kernel that they leave unexplained.

    ``rows`` has one column ``x`` of arrays. In each round every task factorises the batches it
    reads and offers its pivots, the driver picks among the least explained ones. Thinned rows choose up to
    half of the landmarks there may be; all rows decide when it is enough.
    """
    known = Landmarks(np.zeros((0, width)), np.zeros((0, 0)), gamma)
    thinned = rows.where(F.pmod(F.xxhash64("x"), F.lit(_THIN)) == 0)
    known, _ = _explain(thinned, known, tolerance, most // 2)
    return _explain(rows, known, tolerance, most)


@dataclass(frozen=True)
class KernelPca:
    """The embedding, the mean of all rows in it, the components and their variances.

    ``error`` bounds how far each variance is from that of the kernel itself (None for random
    features, which have no such bound); no row keeps more than ``worst`` unexplained.
    """

    embed: Callable[[np.ndarray], np.ndarray]
    centre: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    error: float | None
    worst: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Squared distance to the mean in feature space, less that along the components."""
        if isinstance(self.embed, Landmarks):
            # A row's kernel with itself is 1, of which the embedding may explain a little less.
            own, along = 1.0, self.embed.along(x, np.column_stack([self.centre, self.axes]))
        else:
            z = self.embed(x)
            own, along = (z**2).sum(axis=1), z @ np.column_stack([self.centre, self.axes])
        return own - 2 * along[:, 0] + self.centre @ self.centre - ((along[:, 1:] - self.centre @ self.axes) ** 2).sum(axis=1)


def fit_kernel_pca(
    sample: DataFrame, width: int, components: int = 10, gamma: float | None = None, features: int | None = None,
    tolerance: float = TOLERANCE,
) -> KernelPca:
    """Components of all rows of the column ``x``; ``features`` asks for so many random features instead of landmarks."""
    gamma = gamma if gamma is not None else 1.0 / width
    error = worst = None
    if features:
        embed: Callable[[np.ndarray], np.ndarray] = fourier_features(width, gamma, features)
    else:
        embed, worst = find_landmarks(sample.select("x"), width, gamma, tolerance)
    each = [F.get("x", F.lit(i)) for i in range(width)]
    n, sums, products = gram_sums(sample, each, np.zeros(width), embed)
    if not features:
        # A row's kernel with itself is 1, its share of the trace is what the landmarks explain.
        error = max(0.0, 1 - float(np.trace(products)) / n) if n else 0.0
    centre = sums / max(n, 1.0)
    spread, axes = np.linalg.eigh(products / max(n, 1.0) - np.outer(centre, centre))
    top = np.argsort(spread)[::-1][:components]
    top = top[spread[top] > 1e-10]
    return KernelPca(embed, centre, axes[:, top], spread[top], error, worst)


def _sample(df: DataFrame, row_id: str, columns: list[str], frac: float) -> tuple[DataFrame, DataFrame]:
    """``(row_id, x)`` of all rows, ``x`` null where not sampled or with a gap, and those with ``x``; written once, as every pass reads them."""
    x = F.array(*[number(n) for n in columns])
    taken = in_share(c(row_id), frac, SAMPLE_SEED) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    picked = materialise(df.select(c(row_id).alias("row_id"), F.when(taken, x).alias("x")), "kernel-rows")
    return picked, picked.where(c("x").isNotNull())


def kernel_components(
    df: DataFrame, row_id: str, columns: list[str], frac: float = 1.0, components: int = 10, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(component, variance, error, landmarks)``: variances along the components, and a bound on their error.

    The kernel less what landmarks explain is positive semidefinite, so no variance is off by more
    than the mean of what rows keep unexplained.
    """
    model = fit_kernel_pca(_sample(df, row_id, columns, frac)[1], len(columns), components, tolerance=tolerance)
    rows = [(i + 1, float(v), float(model.error or 0.0), len(model.embed.rows)) for i, v in enumerate(model.variances)]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, error double, landmarks int")


def kernel_pca_outliers(
    df: DataFrame, row_id: str, columns: list[str], frac: float = 1.0,
    contamination: float = 0.05, components: int = 10, features: int | None = None,
) -> DataFrame:
    """``(row_id, score, is_outlier)``: the worst share of the sampled rows is flagged.

    The fit covers every sampled row without a gap. Rows outside the sampled share, or with a gap,
    are kept, with no score and no flag. The score is the squared distance, in feature space, to
    the mean less that along the components.
    """
    picked, sample = _sample(df, row_id, columns, frac)
    model = fit_kernel_pca(sample, len(columns), components, features=features)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            scores = np.zeros(len(known))
            if known.any():
                x = matrix(batch.column(1).drop_null())
                scores[known] = np.concatenate([model.score(x[at:at + _SLAB]) for at in range(0, len(x), _SLAB)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, mask=~known)], names=["row_id", "score"])

    schema = StructType([picked.schema["row_id"], StructField("score", DoubleType())])
    scores = materialise(picked.mapInArrow(score, schema), "kernel_scores")
    cut = quantiles(scores, ["score"], [1 - contamination])["score"][0]
    return scores.withColumn("is_outlier", F.coalesce(c("score") > F.lit(cut), F.lit(False)))
