"""Subgroups that carry the most influence.

A pattern is a conjunction of single-column predicates: a value of a categorical column or
a third of a numeric one. Each row is turned into its few matching items once; counting
items or combinations of items is then one grouped sum with map-side combining, whatever
the number of patterns.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import c, is_numeric, known
from plumbline.operators.binning import Bins, quantile_bins
from plumbline.operators.quantiles import number


def parse_interval(text: str) -> tuple[bool, float, float, bool] | None:
    """``(1.5, 3]`` as (left end included, left, right, right end included); None if it is not one."""
    text = text.strip()
    if len(text) < 5 or text[0] not in "[(" or text[-1] not in "])":
        return None
    ends = text[1:-1].split(",")
    if len(ends) != 2:
        return None
    try:
        lo, hi = (float(e) for e in ends)
    except ValueError:
        return None
    return text[0] == "[", lo, hi, text[-1] == "]"


@dataclass(frozen=True)
class Items:
    """How each column is cut into predicates."""

    columns: tuple[str, ...]
    bins: dict[str, Bins]

    def value(self, name: str, schema: T.StructType) -> Column:
        """Readable predicate value of a row in one column, NULL if there is none."""
        if name in self.bins:
            return self.bins[name].label_of(number(name), self.bins[name].intervals())
        return known(name, schema[name].dataType).cast("string")

    def predicate(self, name: str, value: str, schema: T.StructType) -> Column:
        """The rows that match one predicate, with exact edges for intervals."""
        if name in self.bins:
            labels = self.bins[name].intervals()
            if value in labels:
                return F.coalesce(self.bins[name].index(number(name)) == labels.index(value), F.lit(False))
        return predicate(name, value, schema)


def predicate(name: str, value: object, schema: T.StructType) -> Column:
    """A column predicate: an interval such as ``(1.5, 3]`` of a numeric column, or equality as text."""
    found = parse_interval(value) if isinstance(value, str) and is_numeric(schema[name].dataType) else None
    if not found:
        text = "" if value is None else str(value)
        return F.coalesce(c(name).cast("string") == F.lit(text), F.lit(False))
    left, lo, hi, right = found
    x = number(name)
    above = x >= F.lit(lo) if left else x > F.lit(lo)
    below = x <= F.lit(hi) if right else x < F.lit(hi)
    return F.coalesce(above & below, F.lit(False))


def pattern_items(
    df: DataFrame, exclude: list[str], bin_numerical: bool = True, bins: int = 3
) -> Items:
    """Predicates of every column but the excluded ones; numbers are cut into quantile bins."""
    names = [f for f in df.schema.fields if f.name not in {"influence", *exclude}]
    numeric = [f.name for f in names if is_numeric(f.dataType)] if bin_numerical else []
    cut = quantile_bins(df, numeric, bins) if numeric else {}
    return Items(tuple(f.name for f in names), cut)


def single_patterns(
    df: DataFrame, items: Items, least: float = 0.0, wide: tuple[str, ...] = ()
) -> DataFrame:
    """``(col, val, n, influence_sum)`` of single predicates that cover ``least`` rows.

    ``wide`` names columns with very many values. Their values are first counted by hash
    bucket, a small exchange; a frequent value lies in a frequent bucket, so the others
    never travel.
    """
    pairs = _item_rows(df, items)
    for name in wide:
        buckets = _frequent_buckets(df, items, name, least)
        keep = F.pmod(F.xxhash64("val"), F.lit(_BUCKETS)).isin(*buckets) if buckets else F.lit(False)
        pairs = pairs.where((c("col") != name) | keep)
    return (
        pairs.groupBy("col", "val")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("influence").alias("influence_sum"))
        .where(c("n") >= F.lit(least))
    )


_BUCKETS = 1 << 16


def _frequent_buckets(df: DataFrame, items: Items, name: str, least: float) -> list[int]:
    value = items.value(name, df.schema)
    bucket = F.pmod(F.xxhash64(value), F.lit(_BUCKETS)).alias("b")
    counts = df.where(value.isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    # At most 1 / min_support buckets reach the bound.
    return [r.b for r in counts.where(c("n") >= F.lit(max(least, 1.0))).collect()]


def _item_rows(df: DataFrame, items: Items) -> DataFrame:
    values = [items.value(n, df.schema).alias(n) for n in items.columns]
    long = df.select("influence", *values).unpivot([c("influence")], [c(n) for n in items.columns], "col", "val")
    return long.where(c("val").isNotNull())


def _scores(df: DataFrame, rows: int, normaliser: float) -> DataFrame:
    support = c("n") / F.lit(float(rows))
    responsibility = c("influence_sum") / F.lit(normaliser)
    return df.select(
        "*", F.round(support, 4).alias("support"), F.round(responsibility, 4).alias("responsibility"),
        F.round(responsibility / support, 4).alias("interestingness"),
    )


def top_patterns(
    df: DataFrame,
    exclude: list[str],
    min_support: float = 0.01,
    top_k: int | None = 5,
    max_predicates: int = 1,
    bins: int = 3,
    normalise: str = "abs_sum",
    wide: tuple[str, ...] = (),
    items: Items | None = None,
) -> DataFrame:
    """The ``top_k`` patterns by influence per covered row, best first.

    ``df`` carries ``influence``. Support is the share of rows covered, responsibility the
    share of influence, interestingness their ratio. ``normalise`` divides by the size of the
    summed influence (``abs_sum``) or by the summed sizes (``sum_abs``). At most two
    predicates appear in the output columns; ``pattern`` shows all of them.
    """
    if max_predicates > 1 and min_support <= 0:
        raise ValueError("conjunctions need a min_support above 0, which bounds the frequent predicates")
    items = items or pattern_items(df, exclude, bins=bins)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum("influence").alias("s"), F.sum(F.abs("influence")).alias("a")
    ).first()
    normaliser = abs(sums.s) if normalise == "abs_sum" else sums.a
    singles = single_patterns(df, items, min_support * sums.n, wide)
    if max_predicates == 1:
        found = singles.select(
            "n", "influence_sum", F.array(F.struct("col", "val")).alias("parts"))
    else:
        found = _conjunctions(df, items, singles, min_support * sums.n, max_predicates)
    parts = found.select("*", *[
        F.get(c("parts"), F.lit(i))[k].alias(f"pattern_{k}_{i + 1}")
        for i in range(2) for k in ("col", "val")
    ], pattern_text(c("parts")).alias("pattern"))
    scored = _scores(parts, sums.n, normaliser)
    out = scored.select(
        "pattern_col_1", "pattern_val_1", "pattern_col_2", "pattern_val_2", "pattern",
        "support", "responsibility", "interestingness",
    )
    if top_k is None:
        return out
    return out.orderBy(c("interestingness").desc(), "pattern").limit(top_k)


def _conjunctions(
    df: DataFrame, items: Items, singles: DataFrame, least: float, max_predicates: int
) -> DataFrame:
    """Frequent conjunctions, level by level.

    A conjunction is frequent only if its parts are. A column has at most 1 / min_support
    frequent values, so the frequent items fit on the driver, and a row carries at most one
    per column; only those are combined. A set of items travels as one number, whose digits
    are the items in ascending order.
    """
    base = singles.collect()
    order = {n: i for i, n in enumerate(items.columns)}
    base.sort(key=lambda r: (order[r.col], r.val))
    radix = len(base) + 1
    code_type = "long" if radix**max_predicates < 2**62 else "decimal(38,0)"
    if radix**max_predicates >= 10**38:
        raise ValueError(f"{len(base)} frequent predicates cannot be combined {max_predicates} at a time")
    spots = []
    for name in items.columns:
        mine = [(r.val, i) for i, r in enumerate(base, 1) if r.col == name]
        if mine:
            table = F.create_map(*[F.lit(x) for pair in mine for x in pair])
            spots.append(F.try_element_at(table, items.value(name, df.schema)))
    level = {(i,): (r.n, r.influence_sum) for i, r in enumerate(base, 1)}
    found = dict(level)
    rows = df.select("influence", F.array_compact(F.array(*spots)).alias("items")) if spots else None
    for size in range(2, max_predicates + 1):
        candidates = _candidates(level, size)
        if not candidates:
            break
        codes = rows.select("influence", F.explode(_row_codes(c("items"), size, radix, code_type)).alias("code"))
        if size > 2 and len(candidates) <= _MAX_LISTED:
            codes = codes.where(c("code").isin([_code(s, radix) for s in candidates]))
        # A row holds at most one item per column, so no more than
        # (columns choose size) / min_support sets can be frequent.
        grown = codes.groupBy("code").agg(
            F.count(F.lit(1)).alias("n"), F.sum("influence").alias("influence_sum")
        ).where(c("n") >= F.lit(least)).collect()
        level = {_decode(int(r.code), radix): (r.n, r.influence_sum) for r in grown}
        found |= level
    part = "struct<col:string,val:string>"
    return df.sparkSession.createDataFrame(
        [(n, total, [(base[i - 1].col, base[i - 1].val) for i in ids]) for ids, (n, total) in found.items()],
        f"n bigint, influence_sum double, parts array<{part}>",
    )


# Candidate lists up to this length are checked row by row; longer ones are left to the count.
_MAX_LISTED = 100_000


def _code(ids: tuple[int, ...], radix: int) -> int:
    total = 0
    for i in ids:
        total = total * radix + i
    return total


def _decode(code: int, radix: int) -> tuple[int, ...]:
    ids = []
    while code:
        code, last = divmod(code, radix)
        ids.append(last)
    return tuple(reversed(ids))


def _candidates(level: dict, size: int) -> set[tuple[int, ...]]:
    """Sets of ``size`` items all of whose parts are frequent."""
    tails: dict[tuple[int, ...], list[int]] = {}
    for ids in level:
        tails.setdefault(ids[:-1], []).append(ids[-1])
    out = set()
    for head, lasts in tails.items():
        for a, b in combinations(sorted(lasts), 2):
            grown = (*head, a, b)
            if all(grown[:k] + grown[k + 1:] in level for k in range(size)):
                out.add(grown)
    return out


def _row_codes(items: Column, size: int, radix: int, code_type: str) -> Column:
    """Codes of all ``size``-subsets of a row's items (which come in ascending order)."""
    codes = F.transform(items, lambda i: i.cast(code_type))
    for _ in range(size - 1):
        codes = F.flatten(F.transform(codes, lambda s: F.transform(
            F.filter(items, lambda i: i > s % F.lit(radix)), lambda i: (s * F.lit(radix) + i).cast(code_type))))
    return codes


def score_pattern(df: DataFrame, pattern: dict[str, object]) -> DataFrame:
    """Support, responsibility and interestingness of one pattern, relative to signed influence."""
    match = F.lit(True)
    for name, value in pattern.items():
        match = match & predicate(name, value, df.schema)
    sums = df.agg(
        F.count_if(match).alias("n"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(match, c("influence"))).alias("part"), F.sum("influence").alias("total"),
    )
    support = F.try_divide(c("n").cast("double"), c("rows"))
    responsibility = F.try_divide(F.coalesce("part", F.lit(0.0)), c("total"))
    return sums.select(
        F.lit(" AND ".join(f"{n} = {v}" for n, v in pattern.items())).alias("pattern"),
        support.alias("support"), responsibility.alias("responsibility"),
        F.coalesce(F.try_divide(responsibility, support), F.lit(0.0)).alias("interestingness"),
    )


def pattern_text(parts: Column) -> Column:
    """Readable conjunction: ``a = x AND b = y``."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["col"], F.lit(" = "), p["val"])), " AND ")
