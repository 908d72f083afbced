"""Mahalanobis outliers, and comparing and dropping flagged rows."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.operators.gramian import moments_of
from plumbline.operators.quantiles import number

# Fixed value: ridge added to the covariance.
RIDGE = 1e-6

_EXPRESSION_COLUMNS = 12


def chi_squared_quantile(spark: SparkSession, p: float, df: int) -> float:
    """Quantile of the chi-squared distribution; two degrees of freedom are closed form."""
    if df == 2:
        return -2.0 * math.log1p(-p)
    dist = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(df))
    return float(dist.inverseCumulativeProbability(p))


def mean_and_covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariances over rows where all columns are known, in one scan."""
    _, mean, cov = moments_of(df, [number(n) for n in columns])
    return mean, cov


def squared_distance(columns: list[str], mean: np.ndarray, precision: np.ndarray) -> Column:
    """Quadratic form around the mean; NULL where a column is unknown.

    A few columns are a sum of squares in generated code. More are a matrix product per Arrow
    batch, as an expression would grow with the square of their number.
    """
    root = np.linalg.cholesky(precision).T  # precision = rootᵀ · root
    if len(columns) > _EXPRESSION_COLUMNS:
        @F.pandas_udf("double")
        def distance(rows: pd.Series) -> pd.Series:
            x = np.stack([np.array(r, float) for r in rows]) if len(rows) else np.empty((0, len(mean)))
            found = (((x - mean) @ root.T) ** 2).sum(axis=1)
            return pd.Series(found).where(~np.isnan(found), None)

        return distance(F.array(*[number(n) for n in columns]))
    diffs = [number(n) - F.lit(float(m)) for n, m in zip(columns, mean)]
    total = F.lit(0.0)
    for i in range(len(columns)):
        side = F.lit(0.0)
        for j in range(i, len(columns)):
            side = side + F.lit(float(root[i, j])) * diffs[j]
        total = total + side * side
    return total


def mahalanobis(df: DataFrame, columns: list[str], alpha: float = 0.01) -> DataFrame:
    """Add ``d2`` and ``is_outlier``: squared distance beyond the chi-squared bound.

    Mean and covariance are one aggregate over all rows; scoring is one projection. A row
    with an unknown value has no distance and is no outlier.
    """
    mean, cov = mean_and_covariance(df, columns)
    precision = np.linalg.inv(cov + RIDGE * np.eye(len(columns)))
    bound = chi_squared_quantile(df.sparkSession, 1 - alpha, len(columns))
    scored = df.withColumn("d2", squared_distance(columns, mean, (precision + precision.T) / 2))
    return scored.withColumn("is_outlier", F.coalesce(c("d2") > F.lit(bound), F.lit(False)))


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows that are not flagged; an unknown flag keeps the row."""
    return df.where(~F.coalesce(c(flag), F.lit(False)))


def drop_listed(df: DataFrame, flagged: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is not among the flagged ids."""
    return df.join(flagged.select(row_id).distinct(), row_id, "left_anti")


def attach_flags(df: DataFrame, row_id: str, flags: dict[str, DataFrame]) -> DataFrame:
    """One flag column per method; rows a method does not list are not outliers."""
    for name, listed in flags.items():
        side = listed.select(c(row_id), c("is_outlier").alias(name))
        df = df.join(side, row_id, "left").withColumn(name, F.coalesce(c(name), F.lit(False)))
    return df


def outlier_summary(df: DataFrame, influence: str, statistic: str) -> DataFrame:
    """Counts, shares of all rows and overlap of two flag columns, in one aggregate."""
    a, b = c(influence), c(statistic)

    def share(flag: Column) -> Column:
        return F.round(F.try_divide(F.count_if(flag) * 100.0, F.count(F.lit(1))), 4)

    return df.agg(
        F.count_if(a).alias("influence_outliers_count"), share(a).alias("influence_outliers_pct"),
        F.count_if(b).alias("mahalanobis_outliers_count"), share(b).alias("mahalanobis_outliers_pct"),
        F.count_if(a & b).alias("overlap_count"),
    )


def overlap_table(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows flagged by each method and by every combination, as ``(methods, rows)``."""
    groups = [g for size in range(1, len(flags) + 1) for g in combinations(flags, size)]
    aggs = []
    for g in groups:
        both = c(g[0])
        for name in g[1:]:
            both = both & c(name)
        aggs.append(F.count_if(both).alias(" & ".join(g)))
    one = df.agg(*aggs)
    return one.unpivot([], [c(n) for n in one.columns], "methods", "rows")
