"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

K = 20
SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 100
ROWS_PER_LIST = 2_048
MOST_LISTS = 4_096
RECALL = 0.98
# Width of the error bound in standard deviations of the one-bit estimate.
ERROR_WIDTH = 5.0
_SHARD_ROWS = 8_192
_SHARD_QUERIES = 2_048


@dataclass(frozen=True)
class Index:
    """What is fitted on the sample: list centres, rotation, and how many lists a query probes."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray

    def floor(self, query_ids: np.ndarray, queries: np.ndarray, probes: list[np.ndarray], k: int) -> np.ndarray:
        """For every query a score that k rows of its probed lists reach: the k-th best of the sample there."""
        out = np.full(len(queries), -np.inf)
        where = _nearest_list(self.sample, self.centres)
        probed = np.zeros((len(queries), len(self.centres)), bool)
        for i, lists in enumerate(probes):
            probed[i, lists] = True
        if len(self.sample) > k:
            for at in range(0, len(queries), 256):
                scores = queries[at:at + 256] @ self.sample.T
                scores[query_ids[at:at + 256, None] == self.sample_ids[None]] = -np.inf
                scores[~probed[at:at + 256][:, where]] = -np.inf
                out[at:at + 256] = np.partition(scores, -k, axis=1)[:, -k]
        return out - 1e-9 * (1 + np.abs(np.where(np.isfinite(out), out, 0)))


def usable(vector: Column) -> Column:
    """True for vectors that take part: all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector (double) of the rows that take part; lengths other than the commonest take none."""
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (size["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1)[None] - 2 * sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=count)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1)[None] - 2 * x @ centres.T, axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal vectors give equal scores."""
    return (rows * query).sum(axis=1)


def fit(rows: DataFrame, k: int = K, seed: int = 11) -> Index:
    """Fit lists and rotation on a sample of at most SAMPLE_ROWS rows and choose the probes.

    The sample is the rows of smallest hash of vec_id. For CALIBRATION_QUERIES of them the true
    neighbours are found among all rows; the fewest probes that reach RECALL of them are taken.
    """
    n = rows.count()
    ranked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, 2 * SAMPLE_ROWS / max(n, 1))))
    chosen = ranked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "vector").toArrow()
    sample_ids, sample = chosen["vec_id"].to_numpy(), _matrix(chosen["vector"].combine_chunks())
    d = sample.shape[1]
    lists = max(1, min(MOST_LISTS, n // ROWS_PER_LIST, len(sample) // 8))
    centres = _centres(sample, lists)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    queries = sample[:: max(1, len(sample) // CALIBRATION_QUERIES)][:CALIBRATION_QUERIES]

    def nearest(batches):
        for batch in batches:
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            where = _nearest_list(x, centres)
            scores = x @ queries.T
            for q in range(len(queries)):
                top = _best(scores[:, q], ids, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top), q)), pa.array(scores[top, q]), pa.array(where[top])], names=["q", "score", "list"])

    found = rows.mapInArrow(nearest, "q long, score double, list long")
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "list").toArrow()
    rank = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    needed = np.sort(rank[true.column(0).to_numpy(), true.column(1).to_numpy()])
    return Index(centres, rotation, int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1, sample_ids, sample)


def encode(rows: DataFrame, index: Index) -> DataFrame:
    """Every row with its list, packed code bits, length of its residual and code alignment.

    The residual to the list's centre is rotated and kept as the signs of its components. ``align``
    is the inner product of the unit residual with its own code, the correction of the estimate.
    """

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            where = _nearest_list(x, index.centres)
            turned = (x - index.centres[where]) @ index.rotation.T
            norm = np.sqrt((turned ** 2).sum(1))
            align = np.abs(turned).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(turned.shape[1])
            bits = np.packbits(turned > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(where, pa.int32()),
                 pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(np.where(norm > 0, align, 1.0))],
                names=["vec_id", "vector", "list", "code", "norm", "align"])

    key = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "vector").mapInArrow(
        run, f"vec_id {key}, vector array<double>, list int, code binary, norm double, align double")


def estimate(codes: np.ndarray, norm: np.ndarray, align: np.ndarray, turned: np.ndarray, base: float):
    """Estimated inner products with a query and their error bounds, from codes alone.

    ``turned`` is the rotated query, ``base`` its inner product with the list's centre.
    """
    d = len(turned)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    guess = (signs @ turned.astype(np.float32)) / np.sqrt(d) / align
    spread = np.sqrt(np.maximum(0.0, 1 - align ** 2)) / align / np.sqrt(max(1, d - 1)) * np.sqrt((turned ** 2).sum())
    return base + norm * guess, norm * spread * ERROR_WIDTH + 1e-6 * (np.abs(base) + norm)


def search(queries: DataFrame, rows: DataFrame, index: Index, k: int = K) -> DataFrame:
    """The ``k`` rows of largest inner product found for every query, the query's own id left out.

    ``queries`` and ``rows`` have vec_id and vector. Queries travel to the lists they probe; lists
    of many rows or many queries are split into blocks. The sample of the fit gives every query a score
    that its k-th nearest must reach, so blocks far away report nothing. In a block the codes give an estimate and a
    bound for every row; rows that may reach the k-th best lower bound are scored exactly, in
    doubles. Blocks report their k best and the best of all blocks are the result: query_id,
    rank, vec_id, score; ties go to the smaller vec_id. No usable rows give no result.
    """
    coded = materialise(encode(rows, index), "one-bit-codes")
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(index.centres))])

    def route(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            order = np.argsort(-(x @ index.centres.T), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) <= k + 1).sum(axis=1) + 1
            probes = [row[:max(index.probes, n)] for row, n in zip(order, enough)]
            floor = index.floor(batch.column(0).to_numpy(zero_copy_only=False), x, probes, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p[held[p] > 0] for p in probes], pa.list_(pa.int32())), pa.array(floor)],
                names=["query_id", "query", "lists", "floor"])

    key = rows.schema["vec_id"].dataType.simpleString()
    routed = queries.select("vec_id", "vector").mapInArrow(route, f"query_id {key}, query array<double>, lists array<int>, floor double")
    routed = materialise(routed.select("query_id", "query", "floor", F.explode("lists").alias("list")), "routed")
    asked = {r["list"]: r["n"] for r in routed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    shards = [(i, -(-sizes[i] // _SHARD_ROWS), -(-n // _SHARD_QUERIES)) for i, n in asked.items()]

    def split() -> DataFrame:  # one row per list: at most MOST_LISTS
        return F.broadcast(rows.sparkSession.createDataFrame(shards, "list int, r_shards int, q_shards int"))

    left = coded.join(split(), "list").select(
        "list", F.pmod(F.xxhash64("vec_id", F.lit(1)), "r_shards").cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("q_shards") - 1)).alias("q"), "vec_id", "vector", "code", "norm", "align")
    right = routed.join(split(), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("r_shards") - 1)).alias("r"),
        F.pmod(F.xxhash64("query_id", F.lit(2)), "q_shards").cast("int").alias("q"), "query_id", "query", "floor")

    def block(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            x = _matrix(rows["vector"].combine_chunks())
            ids = rows["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            norm, align = rows["norm"].to_numpy(), rows["align"].to_numpy()
            centre = index.centres[rows["list"][0].as_py()]
            floors = asked["floor"].to_numpy()
            for query_id, known, q in zip(asked["query_id"].to_pylist(), floors, _matrix(asked["query"].combine_chunks())):
                guess, bound = estimate(codes, norm, align, index.rotation @ q, float(q @ centre))
                other = ids != query_id
                low = np.where(other, guess - bound, -np.inf)
                floor = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                maybe = np.flatnonzero(other & (guess + bound >= floor))
                scores = _inner(x[maybe], q)
                maybe, scores = maybe[scores >= known], scores[scores >= known]
                for i in _best(scores, ids[maybe], k):
                    out.append((query_id, ids[maybe[i]], scores[i]))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], id_type), "vec_id": pa.array(columns[1], id_type),
                         "score": pa.array(columns[2], pa.float64())})

    id_type = pa.string() if key == "string" else pa.int64() if key == "bigint" else pa.int32()
    keys = ["list", "r", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        block, f"query_id {key}, vec_id {key}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K) -> DataFrame:
    """Fit, encode and search: the ``k`` nearest of every row of ``table`` for which ``is_query`` holds.

    ``is_query`` is over vec_id. Rows with a null id, and vectors that are null, zero, of an uncommon
    length, or hold null or non-finite components, take no part. Rows of a query's own id are not
    candidates. An empty table gives no rows.
    """
    rows = materialise(vectors(table, id_column, vector_column), "vectors")
    if rows.head(1) == []:
        key = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"query_id {key}, rank int, vec_id {key}, score double")
    return search(rows.where(is_query), rows, fit(rows, k), k)
