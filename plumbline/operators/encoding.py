"""One-hot encoding and the design matrix of linear models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c
from plumbline.operators.profile import value_frequencies


def categories(
    df: DataFrame, columns: list[str], max_categories: int | None = None
) -> dict[str, list[str]]:
    """Sorted known values of each column, as text.

    They become feature names on the driver, so their number is checked, never cut.
    """
    if not columns:
        return {}
    bound = max_categories or AuditConfig().max_categories
    rows = (
        value_frequencies(df, columns).where(c("value").isNotNull())
        .select("col", "value").limit(bound + 1).collect()
    )
    if len(rows) > bound:
        raise ValueError(
            f"columns {columns} have more than {bound} categories together; "
            "raise max_categories or treat the widest as text"
        )
    found: dict[str, list[str]] = {n: [] for n in columns}
    for r in rows:
        found[r.col].append(r.value)
    return {n: sorted(v, key=lambda t: t.encode()) for n, v in found.items()}


def one_hot(
    df: DataFrame, columns: list[str], drop_first: bool = False,
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<value>`` in sorted order.

    ``drop_first`` leaves out the first level, which keeps linear models identifiable.
    """
    levels = levels or categories(df, columns)
    wide = []
    for n in columns:
        text = c(n).cast("string")
        for level in levels[n][1 if drop_first else 0:]:
            flag = F.coalesce((text == F.lit(level)).cast("int"), F.lit(0))
            wide.append(flag.alias(f"{n}_{level}"))
    return df.select(*[c(n) for n in df.columns if n not in set(columns)], *wide)


def _doubles(values: list[float]) -> Column:
    """A constant array; one text literal keeps long ones cheap to build."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass(frozen=True)
class Term:
    """A numeric column, or the levels of a categorical one, inside the design matrix.

    A categorical term reads ``index``, the 0-based position of the row's level. ``title``
    names its features; the column itself must have a plain name, as Spark ML asks for.
    """

    column: str
    levels: tuple[str, ...] = ()
    skip: int = 0  # leading levels left out
    title: str | None = None

    @property
    def names(self) -> list[str]:
        title = self.title or self.column
        if not self.levels:
            return [title]
        return [f"{title}_{v}" for v in self.levels[self.skip:]]

    @property
    def index(self) -> str:
        return f"_idx_{self.column}"


@dataclass(frozen=True)
class Design:
    """Design matrix: where each feature comes from, and dot products as expressions."""

    terms: tuple[Term, ...]

    @classmethod
    def of_numbers(cls, columns: Sequence[str]) -> Design:
        return cls(tuple(Term(n) for n in columns))

    @property
    def names(self) -> list[str]:
        return [n for t in self.terms for n in t.names]

    def __len__(self) -> int:
        return len(self.names)

    def dot(self, weights: Sequence[float]) -> Column:
        """Row · weights, without building the row's vector.

        A categorical term contributes the weight at its level's position.
        """
        total = F.lit(0.0)
        at = 0
        for t in self.terms:
            width = len(t.names)
            part = [float(w) for w in weights[at : at + width]]
            at += width
            if not t.levels:
                total = total + c(t.column) * F.lit(part[0])
            elif width:
                spot = c(t.index).cast("int") - t.skip + 1
                inside = (spot >= 1) & (spot <= width)
                total = total + F.when(inside, F.element_at(_doubles(part), spot)).otherwise(F.lit(0.0))
        return total

    def with_indices(self, df: DataFrame) -> DataFrame:
        """Add the level position of every categorical term."""
        for t in self.terms:
            if t.levels:
                text = f"{t.index}_text"
                indexer = StringIndexerModel.from_labels(
                    list(t.levels), inputCol=text, outputCol=t.index, handleInvalid="keep")
                df = indexer.transform(df.withColumn(text, c(t.column).cast("string"))).drop(text)
        return df

    def with_vector(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Add the feature vector for Spark ML, sparse where one-hot columns dominate."""
        cats = [t for t in self.terms if t.levels]
        hot = {t: f"{t.index}_hot" for t in cats}
        cut = {t: f"{t.index}_cut" for t in cats if t.skip}
        if cats:
            # The indexer's slot for unknown values comes last and is the one dropped.
            encoder = OneHotEncoder(inputCols=[t.index for t in cats], outputCols=list(hot.values()))
            df = encoder.fit(df).transform(df)
        for t, out in cut.items():
            keep = list(range(t.skip, len(t.levels)))
            df = VectorSlicer(inputCol=hot[t], outputCol=out, indices=keep).transform(df)
        inputs = [cut.get(t) or hot.get(t) or t.column for t in self.terms]
        out = VectorAssembler(inputCols=inputs, outputCol=name).transform(df)
        return out.drop(*hot.values(), *cut.values())
