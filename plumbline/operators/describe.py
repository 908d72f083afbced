"""Descriptive statistics and correlations of columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c, columns_of_type
from plumbline.operators.gramian import gram_sums
from plumbline.operators.profile import value_frequencies
from plumbline.operators.quantiles import number, quantiles


def describe_columns(df: DataFrame) -> DataFrame:
    """Per column: known count, distinct values, most frequent value, and for numbers the
    mean, sample deviation, extremes and quartiles.

    Distinct values and modes come from one frequency table, quartiles are exact.
    """
    numeric = columns_of_type(df, "number")
    found = value_frequencies(df).where(c("value").isNotNull()).groupBy("col").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-c("n"), c("value"))).alias("top"), F.max("n").alias("freq"),
    )
    quarter = quantiles(df, numeric, [0.0, 0.25, 0.5, 0.75, 1.0]) if numeric else {}
    spread = {}
    for i in range(0, len(numeric), 100):
        block = numeric[i : i + 100]
        aggs = [F.struct(F.avg(number(n)).alias("m"), F.stddev_samp(number(n)).alias("s")).alias(f"a{j}")
                for j, n in enumerate(block)]
        row = df.agg(*aggs).first()
        spread |= {n: row[f"a{j}"] for j, n in enumerate(block)}
    rows = [
        (i, n, *(spread[n] if n in spread else (None, None)), *quarter.get(n, [None] * 5))
        for i, n in enumerate(df.columns)
    ]
    schema = ("position int, col string, mean double, std double, min double, q25 double, "
              "q50 double, q75 double, max double")
    numbers = df.sparkSession.createDataFrame(rows, schema)
    return numbers.join(found, "col", "left").na.fill({"count": 0, "unique": 0}).select(
        "col", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(col_a, col_b, corr)`` of all pairs of numeric columns, over rows where both are known.

    Every value goes in with a flag that it is known, gaps as zero: the sums of products of values,
    squares and flags hold every pair's moments, so all pairs cost one scan.
    """
    names = columns or columns_of_type(df, "number")
    if not names:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    x = [F.when(~F.isnan(number(n)), number(n)) for n in names]
    shift = np.array([v or 0.0 for v in df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()])
    d = len(names)

    def with_flags(rows: np.ndarray) -> np.ndarray:
        values, flags = rows[:, :d], rows[:, d:]
        values = (values - shift) * flags
        return np.concatenate([values, values**2, flags], axis=1)

    cells = [F.coalesce(v, F.lit(0.0)) for v in x] + [v.isNotNull().cast("double") for v in x]
    _, _, s = gram_sums(df, cells, np.zeros(2 * d), with_flags)
    v, q, f = slice(0, d), slice(d, 2 * d), slice(2 * d, 3 * d)
    n, sa, qa, ab = s[f, f], s[v, f], s[q, f], s[v, v]
    with np.errstate(all="ignore"):
        cov = ab - sa * sa.T / n
        var = qa - sa * sa / n
        corr = cov / np.sqrt(var * var.T)
    np.fill_diagonal(corr, np.where(np.diag(var) > 0, 1.0, np.nan))
    rows = [(a, b, None if n[i, j] < 2 or not np.isfinite(corr[i, j]) else float(corr[i, j]))
            for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")
