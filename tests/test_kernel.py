"""Kernel PCA against the whole kernel matrix."""

import os
import subprocess
import sys

import numpy as np
import pytest

from plumbline.operators import kernel


def points(seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(280, 2)) * 0.4, rng.uniform(-4, 4, size=(20, 2))])


def table(spark, x):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(len(x), None, 1.0), (len(x) + 1, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double").repartition(3)


def exact(x, components, gamma=0.5):
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    centred = k - k.mean(0) - k.mean(0)[:, None] + k.mean()
    spread, axes = np.linalg.eigh(centred)
    spread, axes = spread[::-1][:components], axes[:, ::-1][:, :components]
    return np.diag(centred) - ((axes**2) * spread).sum(1), spread / len(x), centred, axes


@pytest.mark.parametrize("pool", [1024, 40])
def test_scores_are_those_of_the_whole_kernel(spark, monkeypatch, pool):
    monkeypatch.setattr(kernel, "_POOL", pool)
    monkeypatch.setattr(kernel, "_FROM_TASK", 16)
    x = points()
    rows = {r.row_id: r for r in kernel.kernel_pca_outliers(table(spark, x), "id", ["a", "b"]).collect()}
    want = exact(x, 10)[0]
    assert [rows[i].score for i in range(300)] == pytest.approx(want.tolist(), abs=1e-6)
    assert {i for i in range(300) if rows[i].is_outlier} == set(np.argsort(-want)[:15].tolist())
    assert all(rows[i].score is None and not rows[i].is_outlier for i in (300, 301))


def test_variances_keep_their_certificate(spark, monkeypatch):
    x = points()
    want = exact(x, 8)[1]
    for most in (2048, 12):
        monkeypatch.setattr(kernel, "MOST_LANDMARKS", most)
        monkeypatch.setattr(kernel.find_landmarks, "__defaults__", (kernel.TOLERANCE, most))
        got = kernel.kernel_components(table(spark, x), "id", ["a", "b"], components=8).orderBy("component").collect()
        assert all(r.landmarks <= most for r in got)
        for r, v in zip(got, want):
            assert abs(r.variance - v) <= r.error + 1e-9
        assert got[0].error < 1e-8 or most == 12
    assert got[0].error > 1e-4  # too few landmarks are said to be too few


def test_components_solve_the_eigenproblem(spark):
    """Residual norms of the components as functions on all rows."""
    x = points()
    sample = table(spark, x).where("id < 300").selectExpr("array(a, b) AS x")
    model = kernel.fit_kernel_pca(sample, 2, components=6)
    centred = exact(x, 6)[2]
    f = (model.embed(x) - model.centre) @ model.axes
    f /= np.linalg.norm(f, axis=0)
    residual = np.linalg.norm(centred @ f / len(x) - f * model.variances, axis=0)
    assert residual.max() < 1e-6


def test_random_features_stay_an_option(spark):
    x = points()
    rows = {r.row_id: r for r in kernel.kernel_pca_outliers(table(spark, x), "id", ["a", "b"], features=1024).collect()}
    want = exact(x, 10)[0]
    assert np.corrcoef([rows[i].score for i in range(300)], want)[0, 1] > 0.97


@pytest.mark.parametrize("x", [np.zeros((0, 2)), np.ones((5, 2)), np.array([[0.0, 0.0], [1e6, -1e6]])])
def test_few_and_equal_rows(spark, x):
    rows = kernel.kernel_pca_outliers(table(spark, x), "id", ["a", "b"]).collect()
    assert len(rows) == len(x) + 2
    scored = [r.score for r in rows if r.score is not None]
    assert scored == pytest.approx(exact(x, 10)[0].tolist() if len(x) else [], abs=1e-7)


def test_the_source_is_read_once_and_settled_rows_are_not_searched_again(spark, monkeypatch):
    """Every round used to read all rows of the source, and so did the score and the join after it."""
    x, seen, left = points(), spark.sparkContext.accumulator(0), []

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def kept(df, name):
        out = written(df, name)
        if name == "kernel-left":
            left.append(out.count())
        return out

    written = kernel.materialise
    monkeypatch.setattr(kernel, "materialise", kept)
    monkeypatch.setattr(kernel, "_FROM_TASK", 8)
    rows = table(spark, x)
    found = kernel.kernel_pca_outliers(rows.mapInArrow(count, rows.schema), "id", ["a", "b"]).collect()
    assert len(found) == 302 and seen.value == 302
    thinned = left.index(0) + 1
    for part in (left[:thinned], left[thinned:]):
        assert part == sorted(part, reverse=True) and part[-1] == 0
    assert left[0] < 60 and left[thinned] < 300


def test_repeated_ids_give_each_row_once(spark):
    rows = table(spark, points()).selectExpr("id % 3 AS id", "a", "b")
    assert kernel.kernel_pca_outliers(rows, "id", ["a", "b"]).count() == 302


def test_landmarks_of_a_process_that_forked():
    """``np.linalg.inv`` waited for ever at 110 to 126 rows, once a driver had started its JVM."""
    code = """
import subprocess
import numpy as np
from plumbline.operators import kernel
subprocess.Popen(["true"], preexec_fn=lambda: None).wait()
rows = np.random.default_rng(1).uniform(-20, 20, size=(126, 2))
known = kernel.Landmarks(rows[:0], np.zeros((0, 0)), 0.5).with_rows(rows)
assert known.unexplained(rows).max() < 1e-9
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"OMP_NUM_THREADS": "8", "PYTHONPATH": root}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=60)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64])
def test_lower_inverse(n):
    low = np.tril(np.random.default_rng(n).normal(size=(n, n))) + 3 * np.eye(n)
    assert kernel.lower_inverse(low) @ low == pytest.approx(np.eye(n), abs=1e-9)
