"""Importance resampling of documents towards a target corpus, with a distributed quickselect."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.llm.common import partitions, running_start
from plumbline.session import materialise

# Fixed values of the features: most words of one, buckets, words a drawn document has at least, seed of the noise.
LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
# Letters in lower case, digits and all bytes beyond ASCII are parts of words; every other byte is a gap.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLAB = 1 << 20
_PIVOTS = 32
_ROWS_PER_BLOCK = 500_000


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case, a bounded stretch at a time; no word is cut."""
    text = text.translate(_WORDS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _SLAB)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes | None, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Stretch by stretch: how many words it has, and the bucket of every run of words that ends in it."""
    before: list[bytes] = []
    for found in _stretches(text or b""):
        words = before + found
        runs = [np.fromiter(map(crc32, found), np.int64, len(found))]
        for k in range(2, longest + 1):
            starts = range(max(0, len(before) - k + 1), len(words) - k + 1)
            runs.append(np.array([crc32(b" ".join(words[i:i + k])) for i in starts], np.int64))
        yield len(found), np.concatenate(runs) % buckets
        before = words[len(words) - longest + 1:] if longest > 1 else []


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of the one column ``text``.

    Tasks count into an array; the cluster adds up its filled buckets, and the driver gets one
    number for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for _, found in features(text.as_py(), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: thousandths of the log of the shares' quotient, floored."""
    s, t = float(own.sum()) + len(own), float(target.sum()) + len(own)
    quotient = (target + 1.0) * s / ((own + 1.0) * t)
    return np.array([math.floor(1000 * math.log(q)) for q in quotient.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row: gains are looked up in one array per stretch of text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, weight = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                stretch = [(n, len(found), int(gain[found].sum())) for n, found in features(text.as_py(), longest, len(gain))]
                for out, i in ((words, 0), (runs, 1), (weight, 2)):
                    out.append(sum(s[i] for s in stretch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (words, runs, weight)]],
                names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, floored, from a hash of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, order: list[str], k: int) -> Column:
    """The k-th of the rows' composite keys (ascending in ``order``), as a literal; keys are distinct.

    Quickselect: each round takes some keys at random from the range that is left, counts exactly
    how many rows lie below and at each, and keeps the range between two of them. Rows are neither
    sorted nor moved: a round sends a few keys and counts to the driver.
    """
    types = {f.name: f.dataType for f in rows.schema}
    key = F.struct(*order)

    def lit(r: Row) -> Column:
        return F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order])

    left, turn = rows, 0
    while True:
        turn += 1
        chance = F.xxhash64(F.lit(turn), *order)
        taken = left.select(*order, chance.alias("__chance")).orderBy("__chance", *order).limit(_PIVOTS).collect()
        pivots = [lit(r) for r in sorted(taken, key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in order])]
        below = F.size(F.filter(F.array(*pivots), lambda p: p < key))
        counts = left.groupBy(below.alias("below"), F.array_contains(F.array(*pivots), key).alias("at")).count().collect()
        ahead, lower, upper = 0, None, None
        for r in sorted(counts, key=lambda r: (r["below"], r["at"])):
            if ahead + r["count"] >= k:
                if r["at"]:
                    return pivots[r["below"]]
                lower = pivots[r["below"] - 1] if r["below"] else None
                upper = pivots[r["below"]] if r["below"] < len(pivots) else None
                break
            ahead += r["count"]
        k -= ahead
        if lower is not None:
            left = left.where(key > lower)
        if upper is not None:
            left = left.where(key < upper)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document.

    Reads doc_id and text of ``docs`` and text of ``target``. Words are runs of anything but ASCII
    characters that are no letters or digits, A-Z in lower case; features are runs of 1 to
    ``longest`` of them. A document's weight is the sum of its features' gains, its score adds
    hashed Gumbel noise, so that the highest scores are a draw without replacement by weight. Of N
    documents with ``least_words`` words the floor(percent*N/100) highest scores are drawn; ties go
    to the smaller id, null ids last, then fewer features and less weight; of rows alike in all of
    these any are drawn, as they give the same result. Null and empty texts have no features and
    weight 0; an empty table gives no rows; an empty target leaves every gain to the documents'
    own counts. Texts of any length are read a stretch at a time. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weigh(docs, gain, longest).withColumns({
        "score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()})
    scored = materialise(scored.withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull()}), "resampling")
    out = ["doc_id", "n_features", "weight", "score"]
    able = F.col("n_words") >= least_words
    k = percent * scored.where(able).count() // 100
    nothing = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return scored.select(*out, nothing)
    order = ["down", "no_id", "doc_id", "n_features", "weight", "row"]
    drawn = able & (F.struct(*order) <= kth_key(scored.where(able), order, k))
    blocks = max(partitions(docs.sparkSession), math.ceil(k / _ROWS_PER_BLOCK))
    won = scored.where(drawn).select(*order, "score", F.lit(1).alias("one")).repartitionByRange(blocks, *order)
    won = materialise(won.withColumn("block", F.spark_partition_id()), "resampling-drawn")
    ranked = running_start(won, [], "block", [F.col(c) for c in order], "one", "ahead")
    return ranked.select(*out, (F.col("ahead") + 1).cast("long").alias("rank")).unionByName(
        scored.where(~drawn).select(*out, nothing))
