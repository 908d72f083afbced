"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import present
from plumbline.session import materialise

SAMPLE_ROWS = 20_000
SHAPES = 10
KEEP = 0.5
_ROUNDS = 300
_STRENGTH_MOST = 1e6
_SHIFT_MOST = 2.0
_HALF = 1 << 31  # hashes are kept as signed 32-bit numbers
# Upper case to lower, and ASCII punctuation to blanks, in UTF-8 bytes.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and chr(b) in ".,!?;:\"'()[]{}" else b for b in range(256))


def shape(data: bytes, counts: Counter, words: list[bytes]) -> list[float]:
    """Numbers between 0 and 1 on how a text looks: repetition, symbols, case, tables, word lengths."""
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits = int(kinds[65:91].sum()), int(kinds[48:58].sum())
    lower = int(kinds[97:123].sum()) + int(kinds[128:].sum())
    blank = int(kinds[9:14].sum() + kinds[32])
    symbols = max(0, len(data) - upper - lower - digits - blank)
    # Shares of short texts are drawn to what is usual, so that a single mark says little.
    chars, n = max(1, len(data)) + 40, len(words) + 5
    symbols, upper, lower = symbols + 1, upper + 1, lower + 30
    again = sum(map(operator.eq, words, words[1:])) / n
    commonest = max(counts.values(), default=0) / n
    lengths = (sum(map(len, words)) + 25) / n
    return [
        1.0, min(1.0, 4 * again), min(1.0, 3 * max(0.0, commonest - 0.1)) if n > 20 else 0.0, min(1.0, 5 * symbols / chars),
        min(1.0, max(0.0, symbols / chars - 0.06) * 20), min(1.0, 2 * upper / max(1, upper + lower)), min(1.0, 2 * digits / chars),
        min(1.0, 20 * int(kinds[124]) / chars), min(1.0, lengths / 20), float(not words),
    ]


def features(text: str | None) -> tuple[list[float], set[int]]:
    """Shape numbers and the hashed set of lower-cased words of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    plain = Counter(data.translate(_PLAIN).split())
    return shape(data, Counter(words), words), {zlib.crc32(w) - _HALF for w in plain}


@dataclass(frozen=True)
class Head:
    """A logistic classifier on shape numbers and telling words; ``base`` alone if it could not be fitted."""

    base: float
    shapes: list[float] | None
    words: dict[int, float]

    def logit(self, shapes: list[float], hashed: set[int]) -> float:
        if self.shapes is None:
            return math.log(self.base / (1 - self.base))
        return sum(map(operator.mul, shapes, self.shapes)) + sum(self.words[h] for h in self.words.keys() & hashed)


@dataclass(frozen=True)
class Evidence:
    """Two heads: the text is junk, the text is toxic."""

    junk: Head
    toxic: Head

    def good(self, text: str | None) -> float:
        """Probability that a document is neither junk nor toxic, from its text alone."""
        shapes, hashed = features(text)
        junk, toxic = (1 / (1 + math.exp(min(30.0, max(-30.0, h.logit(shapes, hashed))))) for h in (self.junk, self.toxic))
        return junk * toxic


def _telling(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """Words whose documents differ from the rest in the label beyond chance.

    G squared against independence must exceed 2 ln(words): about one of all words would by chance.
    """
    n, positive = len(y), y.sum()
    seen = np.bincount(columns, minlength=words).astype(float)
    hits = np.bincount(columns, y[rows], words)
    g = np.zeros(words)
    for count, total, share in ((hits, positive, seen), (seen - hits, n - positive, seen),
                                (positive - hits, positive, n - seen), (n - positive - seen + hits, n - positive, n - seen)):
        expected = total * share / n
        g += 2 * count * np.log(np.maximum(count, 1e-300) / np.maximum(expected, 1e-300))
    return np.flatnonzero(g > 2 * np.log(max(2, words)))


def _fit_head(shapes: np.ndarray, rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, truth: np.ndarray) -> Head:
    """Logistic regression with a small ridge on shapes and telling words, by Adam over all sampled rows.

    ``rows`` and ``columns`` are the entries of the matrix of documents and words; ``ids`` names the words.
    """
    known = ~np.isnan(truth)
    y = truth[known]
    if not len(y) or y.min() == y.max():
        return Head(1e-3 if not len(y) or y.max() == 0 else 1 - 1e-3, None, {})
    x = shapes[known]
    if not known.all():
        use = known[rows]
        rows, columns = (np.cumsum(known, dtype=np.int32) - 1)[rows[use]], columns[use]
    telling = _telling(rows, columns, y, len(ids))
    place = np.full(len(ids), -1, np.int32)
    place[telling] = np.arange(len(telling))
    use = place[columns] >= 0
    rows, columns = rows[use], place[columns[use]]
    w = np.zeros(SHAPES + len(telling))
    w[0] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(w), np.zeros_like(w)
    # Half way between counting every row alike and every class alike.
    weight = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    for step in range(1, _ROUNDS + 1):
        z = x @ w[:SHAPES] + np.bincount(rows, w[SHAPES:][columns], len(known))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(known)
        g = np.concatenate([x.T @ r, np.bincount(columns, r[rows], len(telling))])
        g[1:] += 1e-5 * w[1:]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = 0.3 * (1 - step / (_ROUNDS + 1))
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-5)
    return Head(float(y.mean()), w[:SHAPES].tolist(), dict(zip(ids[telling].tolist(), w[SHAPES:].tolist())))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Evidence:
    """Fit both heads on a bounded sample of labelled rows.

    ``labels`` has doc_id, quality (0: junk) and toxic (1: toxic); null labels teach nothing. At most
    ``sample_rows`` labelled ids, those of smallest hash, are used; their whole texts become
    features on the executors. Without labels of both kinds a head knows its base rate only, and
    without any label nothing is rejected.
    """
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.float64()), batch.column(2).cast(pa.float64()),
                 pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([list(h) for _, h in found], pa.list_(pa.int32()))],
                names=["quality", "toxic", "shapes", "hashed"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "toxic").mapInArrow(
        run, "quality double, toxic double, shapes array<double>, hashed array<int>").toArrow()
    quality, toxic = (rows[name].to_numpy().astype(float) for name in ("quality", "toxic"))
    shapes = rows["shapes"].combine_chunks().flatten().to_numpy().reshape(-1, SHAPES)
    lists = rows["hashed"].combine_chunks()
    ids, columns = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    entries = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy()), columns.astype(np.int32), ids
    junk = np.where(np.isnan(quality), np.nan, quality == 0)
    return Evidence(_fit_head(shapes, *entries, junk), _fit_head(shapes, *entries, toxic))


def with_evidence(docs: DataFrame, model: Evidence, out: str) -> DataFrame:
    """Add ``out``, the document's own probability of being good, from its whole text."""

    @F.pandas_udf("double")
    def good(texts):
        return texts.map(lambda t: model.good(None if t is None else t))

    return docs.withColumn(out, good(F.col("text")))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def _strength(groups: DataFrame, mean: str, toward: str, n: str) -> float:
    """Prior strength in documents by moments: how little group means differ beyond their sampling."""
    m = F.col(toward)
    noise = m * (1 - m) / F.col(n)
    facts = groups.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * ((F.col(mean) - m) ** 2 - noise)).alias("between"), F.sum(F.col(n) * m * (1 - m)).alias("within")).first()
    if not facts["within"] or facts["between"] is None or facts["between"] <= 0:
        return _STRENGTH_MOST
    return float(min(_STRENGTH_MOST, max(1.0, facts["within"] / facts["between"] - 1)))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Posterior mean quality of every site and path, from columns site, path (never null) and good.

    Paths shrink toward their site and sites toward the global mean, each by a strength that the
    spread of the group means gives. One grouped sum per path carries everything: a site of a third
    of all rows is summed on the map side. Returns site, path, n, total, prior (the site's posterior),
    strength (of that prior) and overall (the global mean).
    """
    paths = materialise(scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("good").alias("total")), "quality-paths")
    whole = paths.agg(F.sum("total") / F.sum("n")).first()[0]
    overall = 0.5 if whole is None else float(whole)
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("total").alias("site_total"))
    sites = sites.withColumn("mean", F.col("site_total") / F.col("site_n")).withColumn("overall", F.lit(overall))
    k = _strength(sites, "mean", "overall", "site_n")
    sites = sites.withColumn("prior", (F.col("site_total") + k * overall) / (F.col("site_n") + k)).select("site", "prior", "overall")
    both = paths.join(sites, "site").withColumn("path_mean", F.col("total") / F.col("n"))
    return both.withColumn("strength", F.lit(_strength(both, "path_mean", "prior", "n"))).drop("path_mean")


def judge(
    docs: DataFrame, model: Evidence, site: Column, path: Column, own: str = "good", keep_text: bool = True
) -> DataFrame:
    """All columns of ``docs`` with ``good``, ``site_posterior``, ``posterior`` and ``keep``.

    With the text kept, texts are read twice and never travel; without it, once, and the rest of the
    columns with the evidence are written to the shared folder between the two steps.

    ``site`` and ``path`` are expressions over ``docs``; null is a site or path of its own. The
    posterior adds to the document's log-odds how far its path's posterior, the document itself left
    out, lies from the global mean, at most two units either way. Columns of these names in
    ``docs`` give way. Null or empty text is judged like any other; no rows give no rows.
    """
    given = docs.drop("site_posterior", "posterior", "keep", own)
    placed = given.withColumns({"__site": present(site), "__path": present(path)})
    scored = with_evidence(placed, model, own)
    if not keep_text:
        given = given.drop("text")
        scored = materialise(scored.drop("text"), "quality-evidence")
    table = site_posteriors(scored.select(
        F.col("__site").alias("site"), F.col("__path").alias("path"), F.col(own).alias("good")))
    table = materialise(table, "quality-sites").select(
        F.col("site").alias("__site"), F.col("path").alias("__path"),
        F.struct("n", "total", "prior", "strength", "overall").alias("__stats"))
    s = F.col("__stats")
    others = (s["total"] - F.col(own) + s["strength"] * s["prior"]) / (s["n"] - 1 + s["strength"])
    shift = F.least(F.lit(_SHIFT_MOST), F.greatest(F.lit(-_SHIFT_MOST), _logit(others) - _logit(s["overall"])))
    odds = _logit(F.col(own)) + shift
    return (
        scored.join(table, ["__site", "__path"])
        .withColumn("site_posterior", others).withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("keep", F.col("posterior") >= KEEP)
        .select(*given.columns, own, "site_posterior", "posterior", "keep")
    )
