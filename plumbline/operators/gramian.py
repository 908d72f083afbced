"""Sums of outer products over many columns, in one scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLAB = 4096
_FOLD = 64


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of arrays of equal length as a matrix; null members become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """The sum of the arrays that tasks give in the one column ``sums``, added up as a tree; None without any."""

    def add(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        return b if a is None else a if b is None else a + b

    arrays = parts.rdd.map(lambda r: np.frombuffer(r.sums, float))
    depth = max(2, int(np.ceil(np.log(max(2, arrays.getNumPartitions())) / np.log(_FOLD))))
    return arrays.treeAggregate(None, add, add, depth)


def gram_sums(df: DataFrame, values: list[Column], shift: np.ndarray, transform=None) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of (values - shift), over rows where all values are known.

    ``transform`` maps a matrix of rows to the matrix that is summed. Every task adds up its rows as
    matrix products and sends one matrix; the matrices are added in a tree, so the driver gets a
    handful. Width squared is what a task holds.
    """

    width = len(values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else np.empty((0, width))
            for at in range(0, len(x), _SLAB):
                rows = x[at:at + _SLAB] - shift
                rows = transform(rows) if transform else rows
                rows = np.column_stack([np.ones(len(rows)), rows])
                part = rows.T @ rows
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    whole = F.array(*values)
    parts = df.select(whole.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).mapInArrow(add, "sums binary")
    flat = tree_sum(parts)
    if flat is None:
        out = width if transform is None else transform(np.zeros((1, width))).shape[1]
        return 0.0, np.zeros(out), np.zeros((out, out))
    side = int(np.sqrt(len(flat)))
    sums = flat.reshape(side, side)
    return float(sums[0, 0]), sums[0, 1:], sums[1:, 1:]


def moments_of(df: DataFrame, values: list[Column]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and sample covariances over rows where all values are known.

    Rows are centred on the mean of the first thousand known rows, which keeps the sums accurate.
    """
    known = F.array(*values)
    first = df.select(known.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).limit(1000).collect()
    if not first:
        return 0.0, np.full(len(values), np.nan), np.zeros((len(values), len(values)))
    shift = np.mean([r.x for r in first], axis=0)
    n, sums, products = gram_sums(df, values, shift)
    mean = sums / n
    return n, mean + shift, (products - n * np.outer(mean, mean)) / max(1.0, n - 1)
