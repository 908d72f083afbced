import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.binning import quantile_bins, range_labels
from plumbline.operators.quantiles import order_statistics, quantiles
from plumbline.operators.scaling import winsor_bounds

PROBS = [0.0, 0.01, 0.1, 1 / 3, 0.5, 0.9, 0.99, 1.0]


def _frame(spark, columns, parts=4):
    names = list(columns)
    rows = list(zip(*[[None if v is None else float(v) for v in columns[n]] for n in names]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts)


@pytest.mark.parametrize("exact_rows", [20, 100_000])
@pytest.mark.parametrize("parts", [1, 32])
def test_same_as_numpy_whatever_the_limit(spark, exact_rows, parts):
    rng = np.random.default_rng(1)
    n = 3000
    hot = rng.normal(size=n)
    hot[: n // 3] = 0.25  # a third of the rows share a value
    columns = {
        "even": rng.uniform(-5, 5, n), "hot": hot, "tail": rng.lognormal(0, 8, n),
        "few": rng.integers(0, 3, n), "same": np.full(n, 7.0),
    }
    df = _frame(spark, columns, parts)
    found = quantiles(df, list(columns), PROBS, exact_rows)
    for name, values in columns.items():
        assert np.allclose(found[name], np.quantile(np.asarray(values, float), PROBS), rtol=1e-14, atol=0), name


def test_order_statistics_are_stored_values(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=2000)
    found = order_statistics(_frame(spark, {"x": values}), {"x": [0, 1, 19, 1000, 1998, 1999]}, exact_rows=10)
    want = np.sort(values)
    assert found["x"] == {r: want[r] for r in (0, 1, 19, 1000, 1998, 1999)}


def test_unknown_values_are_left_out(spark):
    df = _frame(spark, {"x": [1, None, 3, float("nan"), 2], "none": [None] * 5})
    assert quantiles(df, ["x", "none"], [0.5]) == {"x": [2.0], "none": [None]}


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError, match="no rank 3"):
        order_statistics(_frame(spark, {"x": [1, 2, 3]}), {"x": [3]})


def test_winsor_bounds(spark):
    assert winsor_bounds(_frame(spark, {"x": range(1000)}), ["x"]) == {"x": (10.0, 989.0)}
    assert winsor_bounds(_frame(spark, {"x": range(50)}), ["x"]) == {"x": (0.0, 49.0)}


def test_equal_edges_are_merged(spark):
    df = _frame(spark, {"x": [0] * 8 + [1, 2]})
    bins = quantile_bins(df, ["x"], 3)["x"]
    assert bins.edges == (0.0, 2.0)
    rows = df.select("x", bins.index(F.col("x")).alias("b")).collect()
    assert all(r.b == 0 for r in rows)


def test_labels():
    from plumbline.operators.binning import Bins

    assert range_labels(Bins((0.0, 1500.0, 20000.0)), True) == ["0–1,499", "1,500–19,999"]
    assert range_labels(Bins((0.5, 1.25, 3.0)), False) == ["0.50–1.25", "1.25–3.00"]
    assert range_labels(Bins((0.001, 0.002, 0.003)), False) == ["0.001–0.002", "0.002–0.003"]
    assert Bins((1.0, 2.5, 4.0)).intervals() == ["[1.0, 2.5]", "(2.5, 4.0]"]


def test_sketch_margin_only_costs_scans(spark, monkeypatch):
    """Guesses that miss are moved by the counts."""
    import plumbline.operators.quantiles as q

    monkeypatch.setattr(q, "MARGIN", -0.2)
    rng = np.random.default_rng(3)
    values = rng.normal(size=1500)
    found = quantiles(_frame(spark, {"x": values}), ["x"], [0.3, 0.5], exact_rows=20)["x"]
    assert np.allclose(found, np.quantile(values, [0.3, 0.5]), rtol=1e-14)
    assert all(math.isfinite(v) for v in found)
