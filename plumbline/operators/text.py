"""Text columns as TF-IDF weights and two latent components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.operators.gramian import tree_sum
from plumbline.session import materialise

# A token is two or more letters, digits or underscores; at most 3,000 terms
# enter the vocabulary; texts are reduced to two components.
TOKEN = r"[\p{L}\p{N}_]{2,}"
MAX_TERMS = 3000
COMPONENTS = 2

# Columns of the random start, what a component may be off by relative to the first, and most passes.
BLOCK = 32
TOLERANCE = 1e-10
MOST_PASSES = 24
_SEED = 42
_ENTRIES = 1 << 16


def tokens(text: Column) -> Column:
    """Lower-case tokens of a whole text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class Vocabulary:
    """Terms in order with their inverse document frequency."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]


def top_terms(df: DataFrame, column: str, max_terms: int = MAX_TERMS) -> list[str]:
    """The most frequent terms of the corpus, ties by term, in sorted order.

    Counts are combined on the map side, so the commonest words travel once per task.
    """
    return _most_frequent(df.select(tokens(c(column)).alias("tokens")), max_terms)


def _most_frequent(texts: DataFrame, max_terms: int) -> list[str]:
    counts = texts.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(c("n").desc(), "term").limit(max_terms).select("term")
    return sorted(r.term for r in top.collect())  # at most max_terms


def count_vectors(df: DataFrame, column: str, terms: list[str], out: str) -> DataFrame:
    """Add a sparse vector of term counts per row, without a shuffle."""
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol=f"_tok_{out}", outputCol=out)
    return counter.transform(df.withColumn(f"_tok_{out}", tokens(c(column)))).drop(f"_tok_{out}")


def _vocabulary(terms: list[str], counts: DataFrame, name: str) -> Vocabulary:
    """idf = ln((1 + documents) / (1 + documents with the term)) + 1."""
    seen = IDF(inputCol=name, outputCol="_").fit(counts)
    idf = np.log((1.0 + seen.numDocs) / (1.0 + np.array(seen.docFreq, float))) + 1
    return Vocabulary(tuple(terms), tuple(float(v) for v in idf))


def fit_vocabulary(df: DataFrame, column: str, max_terms: int = MAX_TERMS) -> Vocabulary:
    """Two passes over the texts: term counts, then document counts of the chosen terms."""
    texts = df.select(c(column))
    terms = top_terms(texts, column, max_terms)
    if not terms:
        return Vocabulary((), ())
    return _vocabulary(terms, count_vectors(texts, column, terms, "n").select("n"), "n")


def vocabulary_table(df: DataFrame, column: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(term, idf)`` of the vocabulary."""
    vocab = fit_vocabulary(df, column, max_terms)
    return df.sparkSession.createDataFrame(list(zip(vocab.terms, vocab.idf)), "term string, idf double")


def _with_weights(df: DataFrame, column: str, vocab: Vocabulary, out: str) -> DataFrame:
    """Add the TF-IDF weights of a text, scaled to length one, as a struct of indices and values."""
    if not vocab.terms:
        return df.withColumn(out, F.struct(
            F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values")))
    return _weighted(count_vectors(df, column, list(vocab.terms), f"_n_{out}"), vocab, out)


def _weighted(counts: DataFrame, vocab: Vocabulary, out: str) -> DataFrame:
    """Replace the term counts ``_n_<out>`` by weights."""
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(vocab.idf), inputCol=f"_n_{out}", outputCol=f"_w_{out}")
    scaled = Normalizer(p=2.0, inputCol=f"_w_{out}", outputCol=f"_v_{out}").transform(weigh.transform(counts))
    vector = F.unwrap_udt(c(f"_v_{out}"))
    # A vector without gaps is stored dense, without indices.
    indices = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    return scaled.withColumn(out, F.struct(indices.alias("indices"), vector["values"].alias("values"))).drop(
        f"_n_{out}", f"_w_{out}", f"_v_{out}")


def tfidf(
    df: DataFrame, row_id: str, column: str, max_terms: int = MAX_TERMS, vocab: Vocabulary | None = None
) -> DataFrame:
    """``(row_id, term, weight)``: TF-IDF weights, each text scaled to length one.

    Each text is counted where it lies, in the JVM; nothing is shuffled.
    """
    vocab = vocab or fit_vocabulary(df, column, max_terms)
    terms = F.lit(list(vocab.terms)) if vocab.terms else F.array().cast("array<string>")
    rows = df.select(c(row_id).alias("row_id"), c(column).alias("text"))
    weights = _with_weights(rows, "text", vocab, "w").select(
        "row_id", F.explode(F.arrays_zip("w.indices", "w.values")).alias("e"))
    return weights.where(c("e")["values"] > 0).select(
        "row_id", F.get(terms, c("e")["indices"]).alias("term"), c("e")["values"].alias("weight"))


@dataclass(frozen=True)
class Components:
    """Leading right singular vectors of a matrix of rows, squared singular values, what AᵀA v and s² v
    differ by, and passes over the rows."""

    vectors: np.ndarray
    squares: np.ndarray
    residuals: np.ndarray
    passes: int


def product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """AᵀA q in one pass over the sparse rows (indices, values) of A; tasks add up, and a tree adds tasks."""
    width, count = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, count))
        for batch in batches:
            entries = batch.column(0).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                # As many rows as hold some thousands of entries, one at least.
                end = max(at + 1, int(np.searchsorted(entries, entries[at] + _ENTRIES, side="right")) - 1)
                part = batch.slice(at, end - at)
                index, value = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
                row = np.repeat(np.arange(end - at), np.diff(entries[at:end + 1]))
                along = q[index] * value[:, None]
                for j in range(count):
                    images = np.bincount(row, along[:, j], minlength=end - at)
                    total[:, j] += np.bincount(index, value * images[row], minlength=width)
                at = end
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = tree_sum(rows.select("indices", "values").mapInArrow(run, "sums binary"))
    return np.zeros((width, count)) if found is None else found.reshape(width, count)


def leading_components(
    rows: DataFrame, width: int, count: int, block: int = BLOCK, tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES,
) -> Components:
    """The leading ``count`` right singular vectors by a randomised block Krylov method.

    A random block is multiplied by AᵀA again and again, a pass each; the best vectors in the span of
    all blocks so far, and their exact residuals, come from products that are already there. It ends
    once every residual is within ``tolerance`` of the largest squared singular value, usually after
    three or four passes, and raises an error if it does not. The driver holds a few narrow blocks.
    """
    q, _ = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((width, min(block, width))))
    basis, images = q, np.zeros((width, 0))
    for passes in range(1, most_passes + 1):
        y = product(rows, q)
        images = np.hstack([images, y])
        small = basis.T @ images
        squares, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(squares)[::-1][:count]
        vectors, squares = basis @ turn[:, best], np.maximum(squares[best], 0)
        residuals = np.linalg.norm(images @ turn[:, best] - vectors * squares, axis=0)
        if residuals.max(initial=0) <= tolerance * max(squares.max(initial=0), np.finfo(float).tiny):
            return Components(vectors, squares, residuals, passes)
        size = np.linalg.norm(y)
        for _ in range(2):
            y = y - basis @ (basis.T @ y)
        q, r = np.linalg.qr(y)
        q = q[:, np.abs(np.diag(r)) > 1e-14 * size][:, : width - basis.shape[1]]
        if not q.shape[1]:
            return Components(vectors, squares, residuals, passes)  # the span holds all there is
        q, _ = np.linalg.qr(q - basis @ (basis.T @ q))
        basis = np.hstack([basis, q])
    raise RuntimeError(f"components not found in {most_passes} passes (residual {residuals.max():.2g})")


@dataclass(frozen=True)
class TextModel:
    vocab: Vocabulary
    loadings: np.ndarray  # terms × components
    squares: tuple[float, ...] = ()
    residuals: tuple[float, ...] = ()


def fit_text(df: DataFrame, column: str, max_terms: int = MAX_TERMS) -> TextModel:
    """Vocabulary and leading right singular vectors of the TF-IDF matrix.

    The sign of a component makes its largest loading positive. Tokens, counts and weights are written
    once, so texts are searched for tokens in one pass. Any number of columns can be fitted at the same time.
    """
    texts = materialise(df.select(tokens(c(column)).alias("tokens")), "text-tokens")
    terms = _most_frequent(texts, max_terms)
    if not terms:
        return TextModel(Vocabulary((), ()), np.zeros((0, COMPONENTS)))
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="_n_w")
    counts = materialise(counter.transform(texts).select("_n_w"), "text-counts")
    vocab = _vocabulary(terms, counts, "_n_w")
    weights = materialise(_weighted(counts, vocab, "w").select("w.*"), "text-weights")
    found = leading_components(weights, len(vocab.terms), min(COMPONENTS, len(vocab.terms)))
    v = found.vectors
    lead = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    v = v * np.where(lead < 0, -1.0, 1.0)
    return TextModel(vocab, np.pad(v, ((0, 0), (0, COMPONENTS - v.shape[1]))), tuple(found.squares.tolist()), tuple(found.residuals.tolist()))


def text_components(df: DataFrame, column: str, model: TextModel) -> DataFrame:
    """Replace a text column by ``<column>_svd_0`` and ``<column>_svd_1``.

    Weights and their products with the loadings stay in the JVM.
    """
    kept = [c(n) for n in df.columns if n != column]
    weighted = _with_weights(df, column, model.vocab, "_tfidf")
    w = c("_tfidf")

    def along(k: int) -> Column:
        if not model.vocab.terms:
            return F.lit(0.0)
        pull = F.lit([float(x) for x in model.loadings[:, k]])
        parts = F.zip_with(w["indices"], w["values"], lambda i, v: v * F.get(pull, i))
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)

    return weighted.select(*kept, *[along(k).alias(f"{column}_svd_{k}") for k in range(COMPONENTS)])
