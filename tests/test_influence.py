import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.operators.encoding import Design, Term
from plumbline.operators.influence import (
    LogisticInfluence, influence_flags, mean_influence, weighted_feature_sum,
)
from plumbline.operators.logit import fit_logistic
from plumbline.operators.models import LinearModel, fit


@pytest.fixture(scope="module")
def mixed(spark):
    """Two numbers and a category, as a table and as the matrix it stands for."""
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=(n, 2))
    kinds = rng.choice(["a", "b", "c"], n)
    y = (x[:, 0] + (kinds == "b") + rng.normal(size=n) > 0).astype(int)
    rows = [(i, float(x[i, 0]), float(x[i, 1]), str(kinds[i]), int(y[i]), bool(i % 5 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, u double, v double, kind string, label int, is_test boolean")
    return df, x, kinds, y, np.arange(n) % 5 == 0


def _prepared(mixed, skip=0):
    df, x, kinds, y, test = mixed
    design = Design((Term("u"), Term("kind", ("a", "b", "c"), skip), Term("v")))
    hot = np.stack([kinds == k for k in "abc"[skip:]], 1).astype(float)
    return design, design.with_vector(design.with_indices(df)), np.hstack([x[:, :1], hot, x[:, 1:]]), y, test


@pytest.mark.parametrize("skip", [0, 1])
def test_design_dot_and_vector_agree(mixed, skip):
    design, df, m, _, _ = _prepared(mixed, skip)
    w = np.linspace(-1, 1, m.shape[1])
    rows = df.select("id", design.dot(w).alias("d"), "features").orderBy("id").collect()
    assert np.allclose([r.d for r in rows], m @ w)
    assert np.allclose([r.features.toArray() for r in rows], m)
    assert design.names == ["u", *[f"kind_{k}" for k in "abc"[skip:]], "v"]


def _loop(m, y, test, w, b):
    """Influence pair by pair, as defined."""
    p = 1 / (1 + np.exp(-(m @ w + b)))
    train = ~test
    h = (m[train].T * (p * (1 - p))[train]) @ m[train] + 1e-6 * np.eye(m.shape[1])
    inverse = np.linalg.inv(h)
    total = np.zeros(train.sum())
    for i in np.flatnonzero(test):
        g = (p[i] - y[i]) * m[i]
        total += [-g @ inverse @ ((p[j] - y[j]) * m[j]) for j in np.flatnonzero(train)]
    return total / test.sum()


@pytest.mark.parametrize("dense", [512, 1])
def test_logistic_projection_equals_the_loop(mixed, dense):
    design, df, m, y, test = _prepared(mixed, skip=1)
    w, b = np.array([0.8, 0.5, -0.2, 0.1]), -0.3
    model = LinearModel("logistic", tuple(w), b)
    train, tests = df.where(~F.col("is_test")), df.where("is_test")
    cfg = AuditConfig(max_dense_features=dense)
    scored = mean_influence(train, tests, model, design, cfg=cfg).orderBy("id").collect()
    assert np.allclose([r.influence for r in scored], _loop(m, y, test, w, b), rtol=1e-6, atol=1e-12)


def test_hessian(mixed):
    design, df, m, y, _ = _prepared(mixed)
    w = np.array([0.8, 0.5, -0.2, 0.1, 0.0])
    p = 1 / (1 + np.exp(-(m @ w + 0.4)))
    method = LogisticInfluence(LinearModel("logistic", tuple(w), 0.4), design, df)
    assert np.allclose(method.hessian(), (m.T * (p * (1 - p))) @ m)
    v = np.arange(5.0)
    assert np.allclose(method.hessian_times(v), (m.T * (p * (1 - p))) @ m @ v)


def test_svm_projection_equals_the_loop(mixed):
    design, df, m, y, test = _prepared(mixed)
    w, b = np.array([0.8, 0.5, -0.2, 0.1, 0.2]), -0.1
    sign = 2 * y - 1
    grads = np.where((sign * (m @ w + b) < 1)[:, None], -sign[:, None] * m, 0.0)
    want = -(grads[~test] @ grads[test].T).mean(1)
    train, tests = df.where(~F.col("is_test")), df.where("is_test")
    scored = mean_influence(train, tests, LinearModel("svm", tuple(w), b), design).orderBy("id").collect()
    assert np.allclose([r.influence for r in scored], want)


def test_signed_weights_in_feature_sums(mixed):
    design, df, m, _, _ = _prepared(mixed)
    u = np.array([r.u for r in df.orderBy("id").collect()])
    assert np.allclose(weighted_feature_sum(df, F.col("u")), m.T @ u)


def test_flags(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 0, 0, 0, 10])], "id int, influence double")
    assert [r.is_outlier for r in influence_flags(df, 1.0).orderBy("id").collect()] == [False] * 4 + [True]
    low = spark.createDataFrame([(i, -1.0) for i in range(4)], "id int, influence double")
    assert not any(r.is_outlier for r in influence_flags(low, 1.0).collect())


def test_logistic_fit_solves_its_equations(mixed):
    design, df, m, y, _ = _prepared(mixed, skip=1)
    model = fit(df, "logistic", design)
    p = 1 / (1 + np.exp(-(m @ np.array(model.weights) + model.intercept)))
    assert np.allclose(m.T @ (p - y) + model.weights, 0, atol=2e-2)
    assert abs((p - y).sum()) < 2e-2


def test_logistic_fit_is_as_precise_as_doubles(mixed):
    design, df, m, y, _ = _prepared(mixed, skip=1)
    model = fit(df, "logistic", design)
    p = 1 / (1 + np.exp(-(m @ np.array(model.weights) + model.intercept)))
    gradient = np.append(m.T @ (p - y) + model.weights, (p - y).sum())
    assert np.all(np.abs(gradient) <= 1e-10 * np.append(np.abs(m.T) @ np.abs(p - y), np.abs(p - y).sum()))


def test_logistic_steps_are_shortened_where_whole_ones_overshoot(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 1)), [[4000.0]]])
    y = np.append((x[:60, 0] > 0).astype(int), 0)
    rows = [(Vectors.dense(a), int(b)) for a, b in zip(x, y)]
    *w, b = fit_logistic(spark.createDataFrame(rows, ["features", "label"]), 1e-6)
    p = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
    assert np.allclose(np.append(x.T @ (p - y) / len(y) + 1e-6 * np.array(w), (p - y).mean()), 0, atol=1e-8)


def test_svm_fit_is_no_worse_than_its_neighbours(mixed):
    design, df, m, y, _ = _prepared(mixed, skip=1)
    model = fit(df, "svm", design)
    sign = 2 * y - 1

    def cost(w, b):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (m @ w + b)).sum()

    best = cost(np.array(model.weights), model.intercept)
    rng = np.random.default_rng(0)
    tried = [cost(np.array(model.weights) + s * rng.normal(size=m.shape[1]), model.intercept + s * rng.normal())
             for s in (0.3, 0.1, 0.03) for _ in range(50)]
    assert best <= min(tried) * (1 + 1e-3)


def test_one_class_is_refused(mixed):
    design, df, *_ = _prepared(mixed)
    with pytest.raises(ValueError, match="one class"):
        fit(df.where("label = 1"), "logistic", design)
    with pytest.raises(ValueError, match="unknown model"):
        fit(df, "forest", design)


def test_solver_raises_when_unconverged():
    from plumbline.operators.influence import conjugate_gradients

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 30)) * np.logspace(0, 6, 30)
    a = x.T @ x + 1e-6 * np.eye(30)
    b = rng.normal(size=30)
    assert np.allclose(conjugate_gradients(lambda v: a @ v, b, np.diag(a), 300), np.linalg.solve(a, b), rtol=1e-5)
    with pytest.raises(RuntimeError):
        conjugate_gradients(lambda v: a @ v, b, np.diag(a), 3)


def test_mahalanobis_of_many_columns(spark):
    from plumbline.operators.outliers import mahalanobis

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 60)) @ rng.normal(size=(60, 60)) + 100
    names = [f"v{i}" for i in range(60)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(400, None, *map(float, x[0][1:]))],
                               "id long, " + ", ".join(f"{n} double" for n in names))
    got = [r.d2 for r in mahalanobis(df, names).orderBy("id").collect()]
    gap = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(60)), gap)
    assert np.allclose(got[:400], want, rtol=1e-6) and got[400] is None
