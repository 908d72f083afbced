"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 13
SAMPLE_PER_LANGUAGE = 5_000
MOST_LANGUAGES = 1_000
AMBIGUOUS_MARGIN = 0.1
UNDETERMINED = "und"
_SMOOTHING = 0.5
_SLAB = 1 << 20


def _letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the lower-cased text's bytes, white space as one blank."""
    data = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")
    counts = np.zeros(DIMENSIONS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole), _SLAB):
        b = whole[at:at + _SLAB + 2].astype(np.uint32)
        n = min(_SLAB, len(whole) - at)
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 263 + b[2:]
        for size, grams in ((1, b), (2, two), (3, three)):
            mixed = (grams[:n] + np.uint32(size << 26)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return counts


def codewords(languages: int) -> np.ndarray:
    """A codeword of 0/1 bits for every language, far from the others.

    Up to five languages: all splits of them in two. More: random bits, fifteen for every doubling,
    drawn until no bit is constant and no two codewords are alike.
    """
    if languages <= 5:
        splits = np.arange(1, max(2, 1 << (languages - 1)))
        return ((splits[None, :] >> np.arange(languages)[:, None]) & 1).astype(np.int8)
    rng = np.random.default_rng(17)
    bits = 15 * int(np.ceil(np.log2(languages)))
    while True:
        words = rng.integers(0, 2, (languages, bits), dtype=np.int8)
        apart = min(int((words[i] != words[j]).sum()) for i in range(languages) for j in range(i))
        if apart >= bits // 5 and 0 < words.mean(axis=0).min() and words.mean(axis=0).max() < 1:
            return words


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, and one linear n-gram classifier for every bit."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the two nearest codewords are close."""
        if not self.languages or not text or not _letters(text):
            return UNDETERMINED, 0.0, True
        counts = profile(text)
        seen = np.flatnonzero(counts)
        # Every n-gram votes for each bit; the mean vote is the bit's margin.
        margins = (counts[seen] @ self.weights[seen]) / counts.sum() * 8
        signs = self.words * 2 - 1
        loss = np.logaddexp(0, -signs * margins).mean(axis=1)
        close = np.exp(-(loss - loss.min()) * self.words.shape[1])
        share = close / close.sum()
        order = np.argsort(-share, kind="stable")
        second = share[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(share[order[0]]), bool(share[order[0]] - second < AMBIGUOUS_MARGIN)


def fit(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the rows where ``learn`` holds and lang is not null.

    Of every language at most about ``per_language`` rows are used, chosen by hash of the text; each
    task adds up their n-gram profiles, every document weighing the same. A bit's classifier holds
    the log-odds of each n-gram among languages whose codeword has the bit against the others.
    """
    rows = docs.where(learn & F.col("lang").isNotNull()).select("lang", "text")
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    if not counts:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((DIMENSIONS, 0)))
    spark = docs.sparkSession
    shares = spark.createDataFrame(
        [(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text and _letters(text):
                    counts = profile(text)
                    sums[lang] = sums.get(lang, 0) + counts / counts.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.astype("<f4").tobytes() for v in sums.values()], pa.binary())],
            names=["lang", "profile"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f4").astype(float) for x in table["profile"].to_pylist())
        return pa.table({"lang": table["lang"][:1], "profile": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    parts = chosen.mapInArrow(add, "lang string, profile binary")
    merged = parts.groupBy("lang").applyInArrow(merge, "lang string, profile binary").orderBy("lang").collect()
    languages = [r["lang"] for r in merged]
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((DIMENSIONS, 0)))
    sums = np.array([np.frombuffer(r["profile"], "<f4") for r in merged], float)
    rates = sums / sums.sum(axis=1, keepdims=True)
    words = codewords(len(languages))
    floor = _SMOOTHING / DIMENSIONS / 100
    on = np.array([rates[w == 1].mean(axis=0) if (w == 1).any() else rates.mean(axis=0) for w in words.T])
    off = np.array([rates[w == 0].mean(axis=0) if (w == 0).any() else rates.mean(axis=0) for w in words.T])
    return Model(languages, words, np.log((on + floor) / (off + floor)).T)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` read here (doc_id, text) and lang_pred, score and ambiguous of every row.

    The whole text is read. Null text, text without letters and, if nothing was learned, any text
    is "und" with score 0. Equal texts have equal predictions; an empty table gives no rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(1)]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()),
                 pa.array(columns[2], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, lang_pred string, score double, ambiguous boolean")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))
