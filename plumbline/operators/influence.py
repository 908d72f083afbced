"""Influence of training rows on the test loss of a linear model.

The mean influence over test rows is linear in the mean test gradient, so it needs one
aggregate over the test rows, one small system ``H v = mean gradient``, and one projection
of the training rows on ``v``, however many test rows there are. Positive influence means
that weighing the row up raises the test loss.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.ml.feature import Interaction
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c
from plumbline.operators.encoding import Design
from plumbline.operators.models import LinearModel

# Ridge added to the Hessian, and the SVM's regularisation strength.
RIDGE = 1e-6
SVM_STRENGTH = 1.0


class Influence(Protocol):
    """What an influence method has to offer."""

    def mean_gradient(self, test: DataFrame) -> np.ndarray: ...

    def solve(self, gradient: np.ndarray) -> np.ndarray: ...

    def score(self, direction: Sequence[float]) -> Column: ...

    def factor(self) -> Column: ...

    def whitening(self, width: int) -> np.ndarray: ...


def weighted_feature_sum(df: DataFrame, weight: Column, features: str = "features") -> np.ndarray:
    """Sum of weight · features over the rows, as one aggregate on (sparse) vectors."""
    parts = df.select(
        c(features).alias("x"),
        F.greatest(weight, F.lit(0.0)).alias("up"), F.greatest(-weight, F.lit(0.0)).alias("down"),
    )
    # The summary takes weights of one sign only.
    row = parts.agg(
        Summarizer.metrics("sum").summary(c("x"), c("up")).alias("up"),
        Summarizer.metrics("sum").summary(c("x"), c("down")).alias("down"),
    ).first()
    return row.up["sum"].toArray() - row.down["sum"].toArray()


class LogisticInfluence:
    """Logistic loss with the Hessian of the training rows."""

    def __init__(
        self, model: LinearModel, design: Design, train: DataFrame,
        features: str = "features", label: str = "label", cfg: AuditConfig = AuditConfig(),
    ):
        self.model, self.design, self.train = model, design, train
        self.features, self.label, self.cfg = features, label, cfg

    def residual(self) -> Column:
        return self.model.probability(self.design) - c(self.label)

    def curvature(self) -> Column:
        p = self.model.probability(self.design)
        return p * (1 - p)

    def mean_gradient(self, test: DataFrame) -> np.ndarray:
        rows = test.count()
        if not rows:
            raise ValueError("no test rows to measure influence on")
        return weighted_feature_sum(test, self.residual(), self.features) / rows

    def hessian(self) -> np.ndarray:
        """Sum of p(1-p)·x·xᵀ, gathered as a tree of partial d×d sums."""
        weighted = self.train.select(
            F.sqrt(self.curvature()).alias("w"), c(self.features).alias("features"))
        rows = Interaction(inputCols=["w", "features"], outputCol="wx").transform(weighted)
        rows = MLUtils.convertVectorColumnsFromML(rows.select("wx"), "wx")
        return RowMatrix(rows).computeGramianMatrix().toArray()

    def hessian_times(self, v: np.ndarray) -> np.ndarray:
        """Hessian · v in one pass, without forming the matrix."""
        return weighted_feature_sum(self.train, self.curvature() * self.design.dot(v), self.features)

    def solve(self, gradient: np.ndarray) -> np.ndarray:
        if len(gradient) <= self.cfg.max_dense_features:
            h = self.hessian()
            return np.linalg.solve(h + RIDGE * np.eye(len(h)), gradient)
        return conjugate_gradients(
            lambda v: self.hessian_times(v) + RIDGE * v, gradient, self.hessian_diagonal() + RIDGE,
            max_steps=10 * len(gradient))

    def factor(self) -> Column:
        """The gradient of a row's loss is this number times its features."""
        return self.residual()

    def whitening(self, width: int) -> np.ndarray:
        """A matrix W with WᵀW the inverse Hessian, so that influence is -(W g)·(W g')."""
        if width > self.cfg.max_dense_features:
            raise ValueError(f"{width} features: influence by test row takes at most {self.cfg.max_dense_features}")
        return np.linalg.inv(np.linalg.cholesky(self.hessian() + RIDGE * np.eye(width)))

    def hessian_diagonal(self) -> np.ndarray:
        rows = self.train.select(c(self.features).alias("x"), self.curvature().alias("w"))
        found = rows.agg(Summarizer.metrics("normL2").summary(c("x"), c("w")).alias("s")).first()
        return found.s["normL2"].toArray() ** 2

    def score(self, direction: Sequence[float]) -> Column:
        return -self.residual() * self.design.dot(direction)


class SvmInfluence:
    """Hinge loss on labels -1 and +1; the penalty alone stands for the Hessian."""

    def __init__(
        self, model: LinearModel, design: Design, features: str = "features",
        label: str = "label", strength: float = SVM_STRENGTH,
    ):
        self.model, self.design, self.features, self.label = model, design, features, label
        self.strength = strength

    def pull(self) -> Column:
        """The factor of x in the subgradient: -y inside the margin, else 0."""
        y = 2.0 * c(self.label) - 1
        return F.when(y * self.model.margin(self.design) < 1, -y).otherwise(F.lit(0.0))

    def factor(self) -> Column:
        return self.pull()

    def whitening(self, width: int) -> np.ndarray:
        return np.eye(width) / np.sqrt(self.strength)

    def mean_gradient(self, test: DataFrame) -> np.ndarray:
        rows = test.count()
        if not rows:
            raise ValueError("no test rows to measure influence on")
        return weighted_feature_sum(test, self.pull(), self.features) / rows

    def solve(self, gradient: np.ndarray) -> np.ndarray:
        return gradient / self.strength

    def score(self, direction: Sequence[float]) -> Column:
        return -self.pull() * self.design.dot(direction)


def conjugate_gradients(
    times, b: np.ndarray, diagonal: np.ndarray, max_steps: int, tolerance: float = 1e-10
) -> np.ndarray:
    """Solve A x = b for a positive definite A known only by its products and its diagonal.

    Unknowns are scaled by the diagonal, so columns of very different size cost no extra passes.
    Raises if the residual has not come down to ``tolerance`` times the right side.
    """
    scale = 1 / np.sqrt(np.maximum(diagonal, np.finfo(float).tiny))
    x = np.zeros_like(b)
    r = scale * b
    p, rr = r.copy(), float(r @ r)
    goal = tolerance**2 * rr
    for _ in range(max_steps):
        if rr <= goal:
            return scale * x
        ap = scale * times(scale * p)
        step = rr / float(p @ ap)
        x += step * p
        r -= step * ap
        rr, last = float(r @ r), rr
        p = r + (rr / last) * p
    if rr > goal:
        raise RuntimeError(f"conjugate gradients did not converge in {max_steps} steps (residual {np.sqrt(rr):.2g})")
    return scale * x


def influence_of(
    model: LinearModel, design: Design, train: DataFrame,
    features: str = "features", label: str = "label", cfg: AuditConfig = AuditConfig(),
) -> Influence:
    if model.kind == "logistic":
        return LogisticInfluence(model, design, train, features, label, cfg)
    return SvmInfluence(model, design, features, label)


def influence_score(
    train: DataFrame, test: DataFrame, model: LinearModel, design: Design,
    features: str = "features", label: str = "label", cfg: AuditConfig = AuditConfig(),
) -> Column:
    """Mean influence over the test rows, as an expression on training rows."""
    method = influence_of(model, design, train, features, label, cfg)
    return method.score(method.solve(method.mean_gradient(test)))


def mean_influence(
    train: DataFrame, test: DataFrame, model: LinearModel, design: Design,
    features: str = "features", label: str = "label", cfg: AuditConfig = AuditConfig(),
) -> DataFrame:
    """Training rows with ``influence``."""
    return train.withColumn(
        "influence", influence_score(train, test, model, design, features, label, cfg))


def top_influential(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The ``n`` rows with the highest influence."""
    return df.orderBy(c("influence").desc(), c(row_id)).limit(n)


def influence_bound(df: DataFrame, sigma_multiplier: float = 3.0) -> float:
    """Mean plus so many population deviations of ``influence``, at least zero."""
    row = df.agg(F.avg("influence").alias("m"), F.stddev_pop("influence").alias("s")).first()
    return max((row.m or 0.0) + sigma_multiplier * (row.s or 0.0), 0.0)


def influence_flags(df: DataFrame, sigma_multiplier: float = 3.0) -> DataFrame:
    """Add ``is_outlier`` to training rows: influence above the bound of the table."""
    bound = influence_bound(df, sigma_multiplier)
    return df.withColumn("is_outlier", c("influence") > F.lit(bound))
