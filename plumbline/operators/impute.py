"""Filling gaps. Every ``fit`` returns a few values per column; ``fill`` is one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c, known
from plumbline.operators.profile import value_frequencies
from plumbline.operators.quantiles import medians, number

# Fixed value: the category that stands for a gap before one-hot encoding.
PLACEHOLDER = "<MISSING>"


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent known value per column as text, the smallest one on ties."""
    if not columns:
        return {}
    found = (
        value_frequencies(df, columns)
        .where(c("value").isNotNull())
        .groupBy("col")
        .agg(F.min_by("value", F.struct(-c("n"), c("value"))).alias("mode"))
        .collect()  # one row per column
    )
    return {n: None for n in columns} | {r.col: r["mode"] for r in found}


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace NULL and NaN in the named columns; integers become doubles only if needed."""
    out = []
    for f in df.schema.fields:
        value = values.get(f.name)
        if value is None:
            out.append(c(f.name))
            continue
        x = known(f.name, f.dataType)
        if isinstance(value, float) and f.dataType.typeName() != "string":
            x = x.cast("double")
        out.append(F.coalesce(x, F.lit(value)).alias(f.name))
    return df.select(*out)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median for gaps of numeric columns (numbers kept as text become doubles)."""
    found = medians(df, columns)
    wanted = set(columns)
    return df.select(*[
        F.coalesce(number(n), F.lit(found[n])).alias(n) if n in wanted else c(n) for n in df.columns
    ])


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value for gaps of categorical columns."""
    wanted = set(columns)
    found = modes(df, columns)
    return df.select(*[
        F.coalesce(known(f.name, f.dataType).cast("string"), F.lit(found[f.name])).alias(f.name)
        if f.name in wanted else c(f.name) for f in df.schema.fields
    ])


def impute_placeholder(df: DataFrame, columns: list[str]) -> DataFrame:
    """A category of its own for gaps of categorical columns."""
    wanted = set(columns)
    return df.select(*[
        F.coalesce(known(f.name, f.dataType).cast("string"), F.lit(PLACEHOLDER)).alias(f.name)
        if f.name in wanted else c(f.name) for f in df.schema.fields
    ])


def impute_neighbours_single(df: DataFrame, column: str) -> DataFrame:
    """Nearest-neighbour filling of a column on its own.

    With no other column there is no distance to any donor, and the filling value becomes
    the column mean.
    """
    mean = df.agg(F.avg(number(column)).alias("m")).first().m
    return fill(df.withColumn(column, number(column)), {column: mean})
