"""Quantile bins, age decades and histograms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import c
from plumbline.operators.quantiles import number, quantiles

# Ages are clipped to 0-100 and grouped by decade.
AGE_LABELS = ["0-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90-99"]


@dataclass(frozen=True)
class Bins:
    """Ascending edges; bin i holds (edge i, edge i+1], and the first edge itself."""

    edges: tuple[float, ...]

    @property
    def count(self) -> int:
        return len(self.edges) - 1

    def index(self, x: Column) -> Column:
        """0-based bin of a value inside the edges, NULL outside or for NULL."""
        bin_ = F.lit(0)
        for edge in self.edges[1:-1]:
            bin_ = bin_ + (x > F.lit(edge)).cast("int")
        inside = (x >= F.lit(self.edges[0])) & (x <= F.lit(self.edges[-1]))
        return F.when(inside, bin_)

    def label_of(self, x: Column, labels: list[str]) -> Column:
        """Label of the value's bin; a constant column has no bins."""
        if not labels:
            return F.lit(None).cast("string")
        return F.element_at(F.array(*[F.lit(t) for t in labels]), self.index(x) + 1)

    def intervals(self, digits: int = 3) -> list[str]:
        """Readable intervals; digits are added until the edges differ."""
        texts = _distinct_texts(self.edges, digits, _plain)
        return [
            ("[" if i == 0 else "(") + f"{texts[i]}, {texts[i + 1]}]" for i in range(self.count)
        ]


def _plain(value: float, digits: int) -> str:
    text = f"{value:.{digits}f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


def _distinct_texts(edges, digits: int, show) -> list[str]:
    for d in range(digits, 18):
        texts = [show(e, d) for e in edges]
        if len(set(texts)) == len(texts):
            return texts
    return [repr(e) for e in edges]


def quantile_bins(
    df: DataFrame, columns: list[str], q: int, exact_rows: int | None = None
) -> dict[str, Bins]:
    """Bins between ``q`` equal shares of the known values; equal edges are merged."""
    found = quantiles(df, columns, [i / q for i in range(q + 1)], exact_rows)
    return {n: Bins(tuple(sorted(set(e)))) for n, e in found.items() if e[0] is not None}


def range_labels(bins: Bins, whole_numbers: bool) -> list[str]:
    """``a–b`` per bin: two decimals, or whole numbers with the upper end excluded."""
    if whole_numbers:
        ints = [int(e) for e in bins.edges]
        labels = [f"{ints[i]:,}–{ints[i + 1] - 1:,}" for i in range(bins.count)]
        if len(set(labels)) == len(labels):
            return labels
    texts = _distinct_texts(bins.edges, 2, lambda v, d: f"{v:.{d}f}")
    return [f"{texts[i]}–{texts[i + 1]}" for i in range(bins.count)]


def assign_quantile_bins(df: DataFrame, columns: list[str], q: int) -> DataFrame:
    """Adds ``<column>_bin`` (0-based) and ``<column>_range`` for each column."""
    bins = quantile_bins(df, columns, q)
    types = {f.name: f.dataType for f in df.schema.fields}
    extra = []
    for n in columns:
        if n not in bins:
            continue
        labels = range_labels(bins[n], isinstance(types[n], T.IntegralType))
        extra += [bins[n].index(number(n)).alias(f"{n}_bin"),
                  bins[n].label_of(number(n), labels).alias(f"{n}_range")]
    return df.select(*[c(n) for n in df.columns], *extra)


def age_group(x: Column) -> Column:
    """Decade of an age clipped to 0-100; the last decade takes 100 as well."""
    decade = F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(99.0)) / 10).cast("int")
    return F.element_at(F.array(*[F.lit(t) for t in AGE_LABELS]), decade + 1)


def histogram_bin_count(n: int, lo: float, hi: float, q1: float, q3: float, whole: bool) -> int:
    """Automatic number of bins: the narrower of the Freedman-Diaconis and Sturges widths.

    Sturges alone if the quartiles coincide; whole numbers get bins at least one wide.
    """
    spread = hi - lo
    if n == 0 or spread == 0:
        return 1
    sturges = spread / (math.log2(n) + 1)
    fd = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(fd, sturges) if fd > 0 else sturges
    if whole and width < 1:
        width = 1.0
    return math.ceil(spread / width)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(bin, lo, hi, n)`` of an automatic equal-width histogram, empty bins included."""
    q0, q1, q3, q4 = quantiles(df, [column], [0.0, 0.25, 0.75, 1.0])[column]
    spark = df.sparkSession
    schema = "bin int, lo double, hi double, n bigint"
    if q0 is None:
        return spark.createDataFrame([], schema)
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    x = number(column)
    n = df.agg(F.count(x).alias("n")).first().n
    bins = histogram_bin_count(n, q0, q4, q1, q3, whole)
    lo, hi = (q0, q4) if q4 > q0 else (q0 - 0.5, q4 + 0.5)
    spot = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int")
    counts = (
        df.select(F.least(spot, F.lit(bins - 1)).alias("bin"))
        .where(c("bin").isNotNull())
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    width = (hi - lo) / bins
    return (
        spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(counts, "bin", "left")
        .select(
            "bin", (F.lit(lo) + c("bin") * width).alias("lo"),
            (F.lit(lo) + (c("bin") + 1) * width).alias("hi"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )
