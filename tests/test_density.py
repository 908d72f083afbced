"""Noise flags against all pairs of a small table."""

import numpy as np
import pytest

from plumbline.operators.density import density_noise


def _brute(x, eps=0.5, min_samples=5):
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_samples
    return core, ~core & ~(near & core).any(1)


@pytest.mark.parametrize(("dims", "per_task"), [(1, 3), (2, 3), (2, 100_000), (3, 3), (4, 100_000)])
def test_same_as_all_pairs(spark, dims, per_task):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(260, dims)) * rng.choice([0.3, 1.5], size=(260, 1))
    x[:85] = x[0]  # a third of the rows are one point
    x[90:100] = np.round(x[90:100])
    names = [f"v{i}" for i in range(dims)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    found = density_noise(df, "id", names, points_per_task=per_task).orderBy("row_id").collect()
    core, noise = _brute(x)
    assert [r.is_core for r in found] == core.tolist()
    assert [r.is_outlier for r in found] == noise.tolist()


def test_constant_column_and_few_rows(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(3)], "id long, x double")
    assert {r.is_outlier for r in density_noise(df, "id", ["x"]).collect()} == {True}
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "id long, x double")
    assert {r.is_outlier for r in density_noise(df, "id", ["x"]).collect()} == {False}


def test_rows_with_gaps_are_neither(spark):
    rows = [(i, float(i % 3) / 100, 0.0) for i in range(12)] + [(50, 3.0, None), (51, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    found = {r.row_id: (r.is_core, r.is_outlier) for r in density_noise(df, "id", ["x", "y"]).collect()}
    assert found[50] == (None, False) and found[51] == (None, False) and found[0] == (True, False)
