"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, present, running_start, word_count
from plumbline.session import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BLOCK = 4_000
SEED = "mix"


def _key(doc_id: Column) -> Column:
    """A uniform key of 32 hex digits; null ids share one."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size, source_rows) with each source's weight and target.

    Sources in code-point order, null last, take the weights in turn and share the whole size.
    A target stops at ``max_epochs`` times the size; the excess is shared again by weight until
    none is above. Sorted by size per weight, the sources that stop come first, so running sums
    decide all of them in exact integers. One row per source: the windows see nothing else.
    """
    exact = "decimal(38,0)"
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    numbered = totals.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn % len(weights)).cast("long"))
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.col("source_size").cast("double") / F.col("weight"), F.col("source").isNull(), "source"
    ).rowsBetween(Window.unboundedPreceding, -1)
    size, weight = F.col("source_size").cast(exact), F.col("weight").cast(exact)
    cap = (size * max_epochs).cast(exact)
    judged = numbered.select(
        "*",
        (F.sum(size).over(everything) - F.coalesce(F.sum(cap).over(order), F.lit(0))).cast(exact).alias("_rest"),
        (F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(order), F.lit(0))).cast(exact).alias("_weights"),
    ).withColumn("_full", F.col("_rest") * weight > cap * F.col("_weights"))
    rest = F.max(F.when(~F.col("_full"), F.col("_rest"))).over(everything)
    left = F.max(F.when(~F.col("_full"), F.col("_weights"))).over(everything)
    share = (rest * weight).cast("double") / left.cast("double")
    return judged.withColumn(
        "target", F.when(F.col("_full"), cap.cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))
    ).select("source", "source_size", "source_rows", "weight", "target")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Plan of the mix: for every row of ``docs`` how many words each source's cut leaves it.

    Reads doc_id, text and source; other columns are ignored. Returns doc_id, source, size,
    source_size, target, key, before (words ahead of it in its source's order), epochs (whole
    repeats) and taken (words in all repeats, the last one cut at the source's exact budget, so
    that a source's taken words are its target rounded down).

    Rows of a source are ordered by a hash of doc_id. The hash is uniform, so equal hash ranges
    are equal blocks: each block is sorted on its own and block sums are scanned per source.
    Null text has size 0; null source is a source of its own, the last; rows of equal id are
    ordered by size and text digest, so the plan is the same on every run. No rows give no rows;
    sources of size 0 have target 0. A source of one third of all rows is many blocks.
    """
    sized = materialise(
        docs.select(
            F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("digest"), _key(F.col("doc_id")).alias("key"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = materialise(source_targets(totals, weights, max_epochs), "mix-targets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    blocks = F.ceil(F.col("source_rows") / ROWS_PER_BLOCK)
    placed = (
        sized.withColumn("_of", present(F.col("source")))
        .join(targets.withColumn("_of", present(F.col("source"))).drop("source"), "_of")
        .withColumn("_block", F.floor(place * blocks / F.lit(2**32)))
    )
    scanned = running_start(
        placed, ["_of"], "_block", [F.col("key"), F.col("size"), F.col("digest")], "size", "before"
    )
    whole = F.when(
        F.col("source_size") > 0, F.least(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(max_epochs))
    ).otherwise(0).cast("long")
    budget = F.floor("target").cast("long") - whole * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before")))
    return scanned.select(
        "doc_id", "source", "size", "source_size", "target", "digest", "key", "before", whole.alias("epochs"),
        (whole * F.col("size") + last).alias("taken"),
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, repeated and cut as :func:`mix` says.

    All columns of ``docs`` stay. The last repeat of the document at a source's cut holds only its
    first words up to the budget, with n_chars, if there, counted anew. Rows without words stay
    as often as their source's whole epochs, once at least. Documents never travel: each source's cut is one
    row (the first document not taken whole, and its words), met by the scan of ``docs``. Equal
    rows at a cut are treated alike: each is cut to what the first of them may keep.
    """
    plan = materialise(mix(docs, weights, max_epochs), "mix-plan")
    order = F.struct("key", "size", "digest")
    part = F.col("taken") - F.col("epochs") * F.col("size")
    cuts = plan.withColumn("part", part).groupBy("source").agg(
        F.first("epochs").alias("__mix_epochs"),
        F.min(F.when(F.col("part") < F.col("size"), F.struct(order.alias("at"), "part"))).alias("__mix_cut"),
    ).withColumn("__mix_of", present(F.col("source"))).drop("source")
    # One row per source: written first, so that its size is known when the join is planned.
    cuts = materialise(cuts, "mix-cuts")
    size = word_count(F.col("text"))
    here = F.struct(_key(F.col("doc_id")).alias("key"), size.alias("size"), F.xxhash64("text").alias("digest"))
    marked = docs.withColumns({"__mix_of": present(F.col("source")), "__mix_here": here}).join(cuts, "__mix_of")
    cut, at = F.col("__mix_cut"), F.col("__mix_here")
    ahead = cut.isNull() | (at < cut["at"])
    once_more = ahead & ((at["size"] > 0) | (F.col("__mix_epochs") == 0))
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("__mix_epochs").cast("int") + once_more.cast("int"))
    takes = F.when((at == cut["at"]) & (cut["part"] > 0), F.concat(whole, F.array(cut["part"]))).otherwise(whole)
    repeats = marked.withColumn("__mix_take", F.explode(takes))
    take = F.col("__mix_take")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.when(take >= 0, F.array_join(F.slice(pieces, 1, F.greatest(take, F.lit(0)).cast("int")), "")).otherwise(F.col("text"))
    out = {c: F.col(c) for c in docs.columns} | {"text": head}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(take >= 0, F.length(head).cast("long")).otherwise(F.col("n_chars"))
    return repeats.select(*[value.cast(docs.schema[name].dataType).alias(name) for name, value in out.items()])
