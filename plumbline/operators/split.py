"""Repeatable train/test split, samples and row identity from a hash of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c

# Rows that one bounded aggregate may sort.
_SETTLE_ROWS = 100_000


def with_row_id(df: DataFrame, keys: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """Add a stable row id: the only key column as it is, else a digest of the key columns.

    Without a key, every column takes part, so exact copies share their id and always stay
    on the same side of a split.
    """
    if keys and len(keys) == 1:
        return df.withColumn(name, c(keys[0]))
    parts = [F.coalesce(c(n).cast("string"), F.lit("\u0000")) for n in keys or df.columns]
    return df.withColumn(name, F.md5(F.concat_ws("\u0001", *parts)))


def row_digest(row_id: Column, seed: int) -> Column:
    """32 hexadecimal digits, spread evenly over rows, fixed by id and seed."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def in_share(row_id: Column, share: float, seed: int) -> Column:
    """True for about this share of the rows; no shuffle and no second pass."""
    bound = int(share * 2**32)
    if bound >= 2**32:
        return F.lit(True)
    return F.substring(row_digest(row_id, seed), 1, 8) < F.lit(f"{bound:08x}")


MAX_CLASSES = 1000


def sample_share(df: DataFrame, row_id: str, share: float, seed: int = 42) -> DataFrame:
    """Repeatable sample of the rows."""
    return df.where(in_share(c(row_id), share, seed))


def hash_split(df: DataFrame, row_id: str, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Add ``is_test``; label shares are kept in expectation."""
    return df.withColumn("is_test", in_share(c(row_id), cfg.test_size, cfg.seed))


def stratified_split(
    df: DataFrame, row_id: str, label: str, cfg: AuditConfig = AuditConfig()
) -> DataFrame:
    """Add ``is_test`` so that each label gives exactly its rounded share of test rows.

    Per label the lowest digests are test rows. The bound is found by counting digest
    prefixes, four digits at a time, so no label is ever sorted as a whole.
    """
    digests = df.select(c(label).alias("label"), row_digest(c(row_id), cfg.seed).alias("digest"))
    totals = digests.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(totals) > MAX_CLASSES:
        raise ValueError(f"label {label!r} has more than {MAX_CLASSES} classes")
    is_test = F.lit(False)
    open_ = {r.label: ("", int(r.n * cfg.test_size + 0.5)) for r in totals}
    bounds = {}
    if sum(r.n for r in totals) <= _SETTLE_ROWS:
        bounds, open_ = _settle(digests, open_), {}
    while open_:
        # Rows of equal id share a whole digest: all of them go to the side of the first.
        bounds.update({k: v[0] for k, v in open_.items() if len(v[0]) == 32})
        open_ = {k: v for k, v in open_.items() if len(v[0]) < 32}
        if not open_:
            break
        open_, found = _next_prefix(digests, open_)
        bounds.update(found)
        small = {k: v[:2] for k, v in open_.items() if v[2] <= _SETTLE_ROWS}
        if small:
            bounds.update(_settle(digests, small))
        open_ = {k: v[:2] for k, v in open_.items() if k not in small}
    for value, bound in bounds.items():
        mine = c(label).eqNullSafe(F.lit(value))
        is_test = is_test | (mine & (row_digest(c(row_id), cfg.seed) <= F.lit(bound)))
    return df.withColumn("is_test", is_test)


def _mine(open_: dict) -> Column:
    keep = F.lit(False)
    for value, (prefix, _) in open_.items():
        keep = keep | (c("label").eqNullSafe(F.lit(value)) & c("digest").startswith(prefix))
    return keep


def _next_prefix(digests: DataFrame, open_: dict) -> tuple[dict, dict]:
    """Extend each label's prefix by four digits: the bucket where its quota runs out."""
    digits = len(next(iter(open_.values()))[0]) + 4
    buckets = (
        digests.where(_mine(open_))
        .groupBy("label", F.substring("digest", 1, digits).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most 65,536 buckets per label.
    running = Window.partitionBy("label").orderBy("prefix")
    quota = F.lit(None).cast("long")
    for value, (_, k) in open_.items():
        quota = F.when(c("label").eqNullSafe(F.lit(value)), F.lit(k)).otherwise(quota)
    rows = (
        buckets.withColumn("upto", F.sum("n").over(running)).withColumn("k", quota)
        .where((c("upto") >= c("k")) & (c("upto") - c("n") < c("k"))).collect()
    )
    still = {r.label: (r.prefix, r.k - (r.upto - r.n), r.n) for r in rows}
    none = {value: "" for value, (_, k) in open_.items() if k == 0}
    return still, none


def _settle(digests: DataFrame, open_: dict) -> dict:
    """The quota-th lowest digest among each label's last few rows."""
    quota = F.lit(None).cast("int")
    for value, (_, k) in open_.items():
        quota = F.when(c("label").eqNullSafe(F.lit(value)), F.lit(k)).otherwise(quota)
    rows = (
        digests.where(_mine(open_)).groupBy("label")
        .agg(F.sort_array(F.collect_list("digest")).alias("sorted"))
        .select("label", F.get("sorted", quota - 1).alias("bound")).collect()
    )
    return {r.label: r.bound or "" for r in rows}


def first_test_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` test rows that come first in digest order (no global sort)."""
    test = df.where(c("is_test"))
    return test.orderBy(row_digest(c(row_id), seed), c(row_id)).limit(n)
