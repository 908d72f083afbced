"""Density noise: rows that a DBSCAN clustering would leave out.

Noise needs no clusters: a point is core if enough points (itself included) lie within
``eps``, and noise if neither it nor any point within ``eps`` is core. Cells with a diagonal
of ``eps`` settle most points at once: a cell with enough points holds core points only, no
matter how many. Only points of thin cells, a handful per cell, look at their neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.operators.scaling import moments, standardise
from plumbline.session import materialise

# Columns whose blocks are join keys; each doubles the lookups of a point.
KEY_COLUMNS = 6


def density_noise(
    df: DataFrame, row_id: str, columns: list[str], eps: float = 0.5, min_samples: int = 5,
    points_per_task: int = 100_000,
) -> DataFrame:
    """``(row_id, is_core, is_outlier)`` for every row, on standardised columns.

    Equal points are first merged into one weighted point, so columns with few distinct
    values cost what their distinct values cost. A point looks for neighbours in the blocks of
    side 2 eps that the cube of side 2 eps around it touches, two per column, so the pairs it meets
    are those of its surroundings in all columns. Blocks that hold more points than
    ``points_per_task`` are spread over several join keys. A row with a gap is neither core (NULL)
    nor an outlier.
    """
    d = len(columns)
    zs = [f"z{i}" for i in range(d)]
    cells = [f"c{i}" for i in range(d)]
    keys = [f"b{i}" for i in range(min(d, KEY_COLUMNS))]
    scaled = standardise(df, moments(df, columns)).select(
        c(row_id).alias("row_id"), *[c(n).alias(z) for n, z in zip(columns, zs)]
    )
    known = F.lit(True)
    for z in zs:
        known = known & c(z).isNotNull() & ~F.isnan(c(z))
    points = materialise(
        _weighted_points(scaled.where(known), zs, cells, keys, eps, min_samples, points_per_task), "density_points")
    thin = points.where(~c("dense")).select(*zs)
    tzs = [f"t{z}" for z in zs]
    lookups = _lookups(thin, zs, tzs, keys, eps, _salts(points, keys))
    seen = (
        lookups.join(points.select(*zs, *keys, "salt", "w", "dense"), [*keys, "salt"])
        .where(_gap(zs, tzs) <= eps * eps)
        .groupBy(*tzs).agg(F.sum("w").alias("near"), F.max("dense").alias("near_dense"))
        .select(*[c(t).alias(z) for z, t in zip(zs, tzs)], (c("near") >= min_samples).alias("core"), "near_dense")
    )
    judged = materialise(thin.join(seen, zs), "density_thin")

    # Thin points that are core; those with a dense neighbour are settled already.
    cores = judged.where("core").join(points.select(*zs, *keys, "salts", "salt"), zs)
    loose = judged.where(~c("core") & ~c("near_dense")).select(*zs)
    saved = (
        _lookups(loose, zs, tzs, keys, eps, _salts(cores, keys))
        .join(cores.select(*zs, *keys, "salt"), [*keys, "salt"]).where(_gap(zs, tzs) <= eps * eps)
        .select(*[c(t).alias(z) for z, t in zip(zs, tzs)]).distinct()
    )
    border = judged.where(~c("core")).join(saved.withColumn("saved", F.lit(True)), zs, "left").select(
        *zs, (~c("near_dense") & c("saved").isNull()).alias("noise"))
    # Complete rows that find no entry are core.
    return scaled.withColumn("known", known).join(border, zs, "left").select(
        "row_id", F.when(c("known"), c("noise").isNull()).alias("is_core"),
        (c("known") & F.coalesce("noise", F.lit(False))).alias("is_outlier"),
    )


def _salts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that hold points, and over how many join keys each is spread."""
    return points.groupBy(*keys).agg(F.max("salts").alias("salts"))


def _lookups(points: DataFrame, zs: list[str], tzs: list[str], keys: list[str], eps: float, taken: DataFrame) -> DataFrame:
    """Points (as ``tzs``) once for every block and salt that may hold a neighbour of theirs."""
    sides = [
        F.array_distinct(F.array(_block(c(z) - eps, eps), _block(c(z) + eps, eps))) for z in zs[: len(keys)]
    ]
    found = points.select(*[c(z).alias(t) for z, t in zip(zs, tzs)], *[s.alias(f"_{k}") for s, k in zip(sides, keys)])
    for k in keys:
        found = found.withColumn(k, F.explode(f"_{k}")).drop(f"_{k}")
    # Blocks without points drop out here; crowded ones tell how many join keys they use.
    return found.join(taken, keys).select(
        *tzs, *keys, F.explode(F.sequence(F.lit(0).cast("long"), c("salts") - 1)).alias("salt"))


def _block(z: Column, eps: float) -> Column:
    return F.floor(z / F.lit(2 * eps))


def _weighted_points(
    complete: DataFrame, zs: list[str], cells: list[str], keys: list[str], eps: float,
    min_samples: int, points_per_task: int,
) -> DataFrame:
    """Distinct points with weight, block, whether their cell settles them, and a join salt."""
    side = eps / math.sqrt(len(zs)) * (1 - 1e-12)
    merged = complete.groupBy(*zs).agg(F.count(F.lit(1)).alias("w"))
    placed = merged.select(
        "*", *[F.floor(c(z) / side).alias(k) for z, k in zip(zs, cells)], *[_block(c(z), eps).alias(k) for z, k in zip(zs, keys)])
    crowds = placed.groupBy(*cells).agg(F.sum("w").alias("crowd"))
    blocks = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / points_per_task).alias("salts"))
    return placed.join(crowds, cells).join(blocks, keys).select(
        *zs, *keys, (c("crowd") >= min_samples).alias("dense"), "w", "salts",
        F.pmod(F.xxhash64(*zs), c("salts")).alias("salt"))


def _gap(left: list[str], right: list[str]) -> Column:
    total = F.lit(0.0)
    for a, b in zip(left, right):
        total = total + (c(a) - c(b)) * (c(a) - c(b))
    return total
