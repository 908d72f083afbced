"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def present(value: Column) -> Column:
    """A grouping key that is never null and keeps null apart from every text."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), value.cast("string")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(rows: DataFrame, group: list[str], block: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` over all earlier rows of the group.

    Rows are ordered by ``block`` and then ``order``. Blocks are summed on their own, the short
    list of block sums is scanned per group, and rows are scanned inside their block, so a group
    of any size is shared out over its blocks. Group columns and block must not be null.
    """
    sums = rows.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*group, block])
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_start", "_within")
    )


def joining_links(
    sets: list[np.ndarray], group: np.ndarray, candidates: Iterable[tuple[int, np.ndarray]],
    linked: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple[int, int]]:
    """Of the candidates (i, several j) the links that join groups of ``group``, which keeps up with them.

    ``linked`` decides by the size of set i, those of the sets j and what they have in common.
    """
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    members = [code[lo:hi] for lo, hi in zip((ends - size).tolist(), ends.tolist())]
    here = np.zeros(len(kinds), bool)
    for i, j in candidates:
        here[members[i]] = True
        sums = np.concatenate([[0], np.cumsum(here[np.concatenate([members[k] for k in j.tolist()])])])
        here[members[i]] = False
        last = np.cumsum(size[j])
        for k in j[linked(size[i], size[j], sums[last] - sums[last - size[j]])].tolist():
            if group[k] != group[i]:
                group[group == group[k]] = group[i]
                yield i, k
