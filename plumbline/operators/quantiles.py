"""Exact order statistics of many columns by narrowing intervals.

A single exact percentile aggregate keeps every distinct value in one task. Instead, each
wanted rank gets an open interval known to hold it. A sketch of the rows inside proposes two
values around the rank, and one grouped count over all columns proves how many rows lie
below and at them, which shrinks the interval several hundred times. Once few enough rows
remain, a bounded aggregate picks the exact value. The counts decide: the sketch only
affects how many scans are needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c

# Size of a sketch, and the share of ranks around the wanted one that it is sure to cover.
SKETCH_SIZE = 16_384
MARGIN = 8e-4
SKETCH_GROUPS = 256
INTERVALS_PER_SCAN = 16


@dataclass
class _Search:
    """The value of one 0-based rank among the known values of a column."""

    column: str
    rank: int
    lo: float  # the value lies strictly between lo and hi
    hi: float
    below: int  # rows up to and including lo
    upto: int  # rows below hi
    guess: tuple[float, float] | None = None
    value: float | None = None

    @property
    def inside(self) -> int:
        return self.upto - self.below


def number(name: str) -> Column:
    """Known numeric value as double: NULL for NaN or text that is no number."""
    x = c(name).try_cast("double")
    return F.when(~F.isnan(x), x)


def _between(x: Column, lo: float, hi: float) -> Column:
    keep = F.lit(True)
    if lo > -math.inf:
        keep = keep & (x > F.lit(lo))
    if hi < math.inf:
        keep = keep & (x < F.lit(hi))
    return F.when(keep, x)


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, Row]:
    """Known count, minimum and maximum of each column."""
    out: dict[str, Row] = {}
    for i in range(0, len(columns), 60):
        block = columns[i : i + 60]
        aggs = [
            F.struct(F.count(number(n)).alias("n"), F.min(number(n)).alias("lo"),
                     F.max(number(n)).alias("hi")).alias(f"r{j}")
            for j, n in enumerate(block)
        ]
        row = df.agg(*aggs).first()
        out.update({n: row[f"r{j}"] for j, n in enumerate(block)})
    return out


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    ranges: dict[str, Row] | None = None,
    exact_rows: int | None = None,
) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ranks among the known values of each column."""
    exact_rows = exact_rows or AuditConfig().exact_quantile_rows
    ranges = ranges or column_ranges(df, list(ranks))
    todo: list[_Search] = []
    out: dict[str, dict[int, float]] = {name: {} for name in ranks}
    for name, wanted in ranks.items():
        n, lo, hi = ranges[name]
        for rank in sorted(set(wanted)):
            if not 0 <= rank < n:
                raise ValueError(f"column {name!r} has {n} known values, so no rank {rank}")
            s = _Search(name, rank, -math.inf, math.inf, 0, n)
            s.value = lo if rank == 0 else hi if rank == n - 1 else None
            todo.append(s)
    while True:
        for s in todo:
            if s.value is not None:
                out[s.column][s.rank] = s.value
        todo = [s for s in todo if s.value is None]
        if not todo:
            return out
        many = [s for s in todo if s.inside > exact_rows]
        if many:
            _guess(df, many)
            _count(df, many)
        else:
            _settle(df, todo)


def _by_interval(searches: list[_Search]) -> list[list[tuple[tuple, list[_Search]]]]:
    """Searches that share column and interval together, in blocks for one scan each."""
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault((s.column, s.lo, s.hi), []).append(s)
    groups = list(shared.items())
    return [groups[i : i + INTERVALS_PER_SCAN] for i in range(0, len(groups), INTERVALS_PER_SCAN)]


def _cells(df: DataFrame, marks: dict[str, list[float]]) -> DataFrame:
    """``(i, b, x)``: known values of column i, and between which of its marks they lie.

    Bucket b starts at mark b - 1. Marks are doubles, so an open or closed end is a mark at
    the value itself or at the next larger double.
    """
    names = list(marks)
    values = df.select(*[number(n).alias(f"x{i}") for i, n in enumerate(names)])
    placed = Bucketizer(
        splitsArray=[[-math.inf, *(marks[n] or [0.0]), math.inf] for n in names],
        inputCols=[f"x{i}" for i in range(len(names))],
        outputCols=[f"b{i}" for i in range(len(names))], handleInvalid="keep",
    ).transform(values)
    cells = [
        F.struct(F.lit(i).alias("i"), c(f"b{i}").cast("int").alias("b"), c(f"x{i}").alias("x"))
        for i in range(len(names))
    ]
    return placed.select(F.inline(F.array(*cells))).where(c("x").isNotNull())


def _after(value: float) -> float:
    return math.nextafter(value, math.inf)


def _settle(df: DataFrame, searches: list[_Search]) -> None:
    """Sort the few rows inside the intervals and read off the ranks.

    Overlapping intervals of a column are joined; rows outside of all drop out first.
    """
    ranges: dict[str, list[list[_Search]]] = {}
    for s in sorted(searches, key=lambda s: (s.lo, s.hi)):
        mine = ranges.setdefault(s.column, [])
        if mine and s.lo < max(m.hi for m in mine[-1]):
            mine[-1].append(s)
        else:
            mine.append([s])
    marks, spots, wanted = {}, [], {}
    for i, (name, groups) in enumerate(ranges.items()):
        ends = [(g[0].lo, max(m.hi for m in g)) for g in groups]
        marks[name] = sorted({e for lo, hi in ends for e in (_after(lo), hi) if abs(lo) < math.inf or e == hi}
                             - {math.inf})
        starts = [-math.inf, *(marks[name] or [0.0])]
        owner = [next((k for k, (lo, hi) in enumerate(ends) if (lo < e or lo == e == -math.inf) and e < hi), -1)
                 for e in starts]
        spots.append(F.element_at(F.array(*[F.lit(k) for k in owner]), c("b") + 1))
        for k, group in enumerate(groups):
            wanted[f"{i}:{k}"] = group
    owner = F.lit(-1)
    for i, spot in enumerate(spots):
        owner = F.when(c("i") == i, spot).otherwise(owner)
    positions = F.create_map(*[
        x for key, group in wanted.items()
        for x in (F.lit(key), F.array(*[F.lit(s.rank - group[0].below + 1) for s in group]))
    ])
    rows = (
        _cells(df, marks).withColumn("r", owner).where(c("r") >= 0)
        .groupBy(F.concat_ws(":", "i", "r").alias("key"))
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .select("key", F.transform(positions[c("key")], lambda p: F.element_at("xs", p)).alias("found"))
    )
    for r in rows.collect():
        for s, value in zip(wanted[r.key], r.found):
            s.value = value


def _guess(df: DataFrame, searches: list[_Search]) -> None:
    """Two values around each rank, from a sketch of the rows inside its interval.

    Sketches are merged in two steps, so no task receives those of all partitions.
    """
    for block in _by_interval(searches):
        inside = df.select(
            F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"),
            *[_between(number(name), lo, hi).alias(f"x{j}") for j, ((name, lo, hi), _) in enumerate(block)],
        )
        size = F.lit(SKETCH_SIZE)
        partial = inside.groupBy("g").agg(
            *[F.kll_sketch_agg_double(f"x{j}", size).alias(f"k{j}") for j in range(len(block))])
        merged = partial.agg(
            *[F.kll_merge_agg_double(f"k{j}", size).alias(f"k{j}") for j in range(len(block))])
        picks = []
        for j, (_, members) in enumerate(block):
            spots = [
                min(max((s.rank - s.below + 0.5) / s.inside + side, 0.0), 1.0)
                for s in members for side in (-MARGIN, MARGIN)
            ]
            picks.append(F.kll_sketch_get_quantile_double(
                c(f"k{j}"), F.array(*[F.lit(p) for p in spots])).alias(f"q{j}"))
        row = merged.select(*picks).first()
        for j, (_, members) in enumerate(block):
            for i, s in enumerate(members):
                s.guess = (row[f"q{j}"][2 * i], row[f"q{j}"][2 * i + 1])


def _count(df: DataFrame, searches: list[_Search]) -> None:
    """Count the rows below and at all guesses, and move each search accordingly.

    Buckets between consecutive guesses, and from a guess to the next larger double, make
    "below" and "equal" exact; one small grouped count covers all columns.
    """
    marks = {
        n: sorted({e for s in searches if s.column == n for g in s.guess for e in (g, _after(g))})
        for n in sorted({s.column for s in searches})
    }
    counts = _cells(df, marks).groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"))
    seen = {(r.i, r.b): r.n for r in counts.collect()}
    under = {}  # rows below each mark
    for i, n in enumerate(marks):
        running = 0
        for b, mark in enumerate(marks[n]):
            running += seen.get((i, b), 0)
            under[n, mark] = running
    for s in searches:
        a, b = s.guess
        below_a, to_a = under[s.column, a], under[s.column, _after(a)]
        below_b, to_b = under[s.column, b], under[s.column, _after(b)]
        if s.rank < below_a:
            s.hi, s.upto = a, below_a
        elif s.rank < to_a:
            s.value = a
        elif s.rank < below_b:
            s.lo, s.below, s.hi, s.upto = a, to_a, b, below_b
        elif s.rank < to_b:
            s.value = b
        else:
            s.lo, s.below = b, to_b


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    exact_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; None for a column without known values."""
    ranges = column_ranges(df, columns)
    filled = [n for n in columns if ranges[n].n]
    spots = {n: [p * (ranges[n].n - 1) for p in probs] for n in filled}
    ranks = {n: [r for x in xs for r in (math.floor(x), math.ceil(x))] for n, xs in spots.items()}
    found = order_statistics(df, ranks, ranges, exact_rows) if filled else {}
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in columns}
    for n, xs in spots.items():
        at = found[n]
        out[n] = [
            at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x))
            for x in xs
        ]
    return out


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {n: q[0] for n, q in quantiles(df, columns, [0.5]).items()} if columns else {}
