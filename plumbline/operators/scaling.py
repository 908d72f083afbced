"""Winsorising and standard scaling of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.operators.quantiles import column_ranges, number, order_statistics


def winsor_bounds(
    df: DataFrame, columns: list[str], share: float = 0.01
) -> dict[str, tuple[float, float]]:
    """Values at which a share of the rows at either end is clamped."""
    ranges = column_ranges(df, columns)
    ranks = {}
    for n in columns:
        size = ranges[n].n
        cut = int(share * size)
        if size:
            ranks[n] = [cut, size - 1 - cut]
    found = order_statistics(df, ranks, ranges) if ranks else {}
    return {n: (found[n][lo], found[n][hi]) for n, (lo, hi) in ranks.items()}


def clamp(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    def one(n: str):
        lo, hi = bounds[n]
        x = number(n)
        return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x).alias(n)

    return df.select(*[one(n) if n in bounds else c(n) for n in df.columns])


def winsorise(df: DataFrame, columns: list[str], share: float = 0.01) -> DataFrame:
    return clamp(df, winsor_bounds(df, columns, share))


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one aggregate per 100 columns."""
    out = {}
    for i in range(0, len(columns), 100):
        block = columns[i : i + 100]
        aggs = []
        for j, n in enumerate(block):
            aggs += [F.avg(number(n)).alias(f"m{j}"), F.stddev_pop(number(n)).alias(f"s{j}")]
        row = df.agg(*aggs).first()
        out.update({n: (row[f"m{j}"], row[f"s{j}"]) for j, n in enumerate(block)})
    return out


def standardise(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Centre and divide by the population deviation; a constant column becomes zero."""

    def one(n: str):
        mean, dev = params[n]
        return ((number(n) - F.lit(mean)) / F.lit(dev or 1.0)).alias(n)

    return df.select(*[
        one(n) if n in params and params[n][0] is not None else c(n) for n in df.columns
    ])


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return standardise(df, moments(df, columns))
