"""Turning any target column into a 0/1 label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.functions.missing import without_marker
from plumbline.operators.impute import modes
from plumbline.operators.profile import Roles
from plumbline.operators.quantiles import number, quantiles


def label_from_class(target: str, positive: object) -> Column:
    """1 for the given class, else 0."""
    return F.coalesce((c(target) == F.lit(positive)).cast("int"), F.lit(0))


def median_label(df: DataFrame, target: str) -> Column:
    """0 up to the median, 1 above; gaps count as the mean of the column."""
    mean = df.agg(F.avg(number(target)).alias("m")).first().m
    if mean is None:
        raise ValueError(f"target column {target!r} has no numeric value")
    filled = df.select(F.coalesce(number(target), F.lit(mean)).alias("y"))
    low, median, high = quantiles(filled, ["y"], [0.0, 0.5, 1.0])["y"]
    if median in (low, high):
        raise ValueError(f"target column {target!r} has one class only: its median is an extreme")
    return (F.coalesce(number(target), F.lit(mean)) > F.lit(median)).cast("int")


def majority_label(df: DataFrame, target: str) -> Column:
    """1 for the most frequent value (gaps are filled with it), else 0."""
    text = without_marker(c(target).cast("string"))
    mode = modes(df.select(text.alias("y")), ["y"])["y"]
    if mode is None:
        raise ValueError(f"target column {target!r} has no value")
    return F.coalesce((text == F.lit(mode)).cast("int"), F.lit(1))


def binary_label(df: DataFrame, target: str, roles: Roles) -> Column:
    """Label rule by kind of target: numbers split at the median, classes by majority."""
    return median_label(df, target) if roles.numeric_target else majority_label(df, target)


def pick_target(df: DataFrame, roles: Roles, wanted: str | None) -> str:
    """The wanted target if usable, else the last usable column if none is asked for."""
    usable = [n for n in df.columns
              if n in roles.numeric or n in roles.categorical or n in roles.sensitive]
    if wanted:
        if wanted in usable:
            return wanted
        raise ValueError(f"target column {wanted!r} is not valid for this dataset")
    if not usable:
        raise ValueError("no valid target column found")
    return usable[-1]
