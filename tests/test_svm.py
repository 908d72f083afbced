"""The support vector machine against its certificate and against other points."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from plumbline.operators.logit import fit_logistic
from plumbline.operators.svm import fit_svm


def table(spark, x, y):
    rows = [(Vectors.dense(a), int(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["features", "label"]).repartition(3)


def objective(w, b, x, y, penalty):
    return penalty / 2 * w @ w + np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean()


@pytest.mark.parametrize("n, width, seed, share", [(400, 3, 1, 0.5), (300, 12, 2, 0.1), (60, 2, 3, 0.5)])
def test_gap_certifies_the_optimum(spark, n, width, seed, share):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.choice([0.3, 1, 4], size=width)
    score = x @ rng.normal(size=width) + rng.normal(size=n) * 2
    y = (score > np.quantile(score, 1 - share)).astype(int)
    found = fit_svm(table(spark, x, y), 1.0 / n, gap=1e-3)
    assert found.primal == pytest.approx(objective(found.weights, found.intercept, x, y, 1.0 / n))
    assert 0 <= found.gap + 1e-9 and found.gap <= 1e-3 * max(1, found.primal)
    for _ in range(300):  # no point near or far is better by more than the gap
        size = 10 ** rng.uniform(-4, 0)
        w, b = found.weights + size * rng.normal(size=width), found.intercept + size * rng.normal()
        assert objective(w, b, x, y, 1.0 / n) >= found.dual - 1e-9


def test_separable_and_one_sided_rows(spark):
    x = np.array([[-2.0], [-1.0], [1.0], [2.0]])
    found = fit_svm(table(spark, x, np.array([0, 0, 1, 1])), 0.01)
    assert found.weights[0] == pytest.approx(1, abs=1e-2) and found.intercept == pytest.approx(0, abs=1e-2)
    assert found.gap <= 1e-4
    copies = fit_svm(table(spark, np.repeat(x, 5, axis=0), np.repeat([0, 0, 1, 1], 5)), 0.01)
    assert copies.primal == pytest.approx(found.primal, abs=1e-4)
    still = fit_svm(table(spark, np.zeros((6, 2)), np.array([0, 1, 1, 0, 1, 1])), 0.1)
    assert still.primal == pytest.approx(2 / 3, abs=2e-4) and still.gap <= 1e-4
    with pytest.raises(ValueError, match="no training rows"):
        fit_svm(table(spark, x, np.array([0, 0, 1, 1])).where("label > 5"), 0.1)


@pytest.mark.parametrize("fit", [lambda df: fit_svm(df, 0.01).passes, lambda df: len(fit_logistic(df, 0.01))])
def test_rows_are_prepared_once(spark, fit):
    rng = np.random.default_rng(5)
    places = rng.integers(0, 8, 200)
    rows = [(Vectors.sparse(9, [int(p), 8], [1.0, float(v)]), int(v + (p > 3) > 0.5)) for p, v in zip(places, rng.normal(size=200))]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def label(y):
        seen.add(1)
        return y

    df = spark.createDataFrame(rows, ["features", "y"]).repartition(3)
    assert fit(df.withColumn("label", label("y"))) > 5
    assert seen.value <= 400  # passes read what was written, not the source


def test_sparse_and_dense_rows_fit_alike(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)) * (rng.random((120, 5)) < 0.4)
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(int)
    mixed = [(Vectors.dense(a) if i % 3 else Vectors.sparse(5, {int(j): float(a[j]) for j in np.flatnonzero(a)}), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    one, two = fit_logistic(table(spark, x, y), 0.1), fit_logistic(spark.createDataFrame(mixed, ["features", "label"]), 0.1)
    assert one == pytest.approx(two, abs=1e-9)


def test_a_small_penalty_takes_no_more_steps(spark):
    """Of many rows the penalty is small, and along one-hot columns it alone bends the loss."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    x = np.column_stack([rng.normal(size=300), np.eye(4)[a], np.eye(3)[b]])
    y = (x[:, 0] + 0.5 * (a > 1) - 0.4 * b + rng.normal(size=300) > 0).astype(int)
    df = table(spark, x, y)
    few, many = fit_svm(df, 1.0 / 300), fit_svm(df, 1.0 / 3e8)
    assert many.gap <= 1e-4 and many.passes <= 2 * few.passes
    assert many.primal == pytest.approx(objective(many.weights, many.intercept, x, y, 1.0 / 3e8))
