"""Connected components of a graph of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise_and_clear as materialise


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with the least neighbour of ``a``, itself included."""
    least = links.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return links.join(least, "a")


def _facts(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not its component's least.

    Alternates large-star and small-star steps until nothing changes. Every round is a grouped
    minimum and a join on the links, written to the shared folder, so neither links nor components
    reach the driver and a lost executor costs one round at most.
    """
    stars = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _facts(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        tied = large.join(least, "a")
        small = least.select("a", F.col("least").alias("b")).unionByName(
            tied.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        stars = materialise(small.distinct(), "links")
        after = _facts(stars)
        if after == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
