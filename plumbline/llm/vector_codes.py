"""Product codes of vectors: exact k-means per part over metric trees built by the anchors hierarchy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import present
from plumbline.session import materialise

# Parts of a vector, entries of a codebook, rounds, steps to the unit.
PARTS = 8
ENTRIES = 16
ROUNDS = 6
STEPS = 4096
# Largest component in steps: squared distances of a part of up to 128 components stay exact in 64 bits.
_MOST = 1 << 27
_BLOCK = 8192
_LEAF = 24
_NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8"), ("count", "<i8")])


def steps(flat: np.ndarray) -> np.ndarray:
    """floor(STEPS * x) as integers."""
    x = np.floor(flat.astype(np.float64) * STEPS)
    if x.size and np.abs(x).max() > _MOST:
        raise ValueError(f"components beyond {_MOST / STEPS:g} cannot be coded exactly")
    return x.astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every entry."""
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


@dataclass
class Ball:
    """A ball that covers weighted points: their number, their sum, a centre and a radius."""

    count: int
    total: np.ndarray
    centre: np.ndarray
    radius: float
    index: np.ndarray | None = None
    left: Ball | None = None
    right: Ball | None = None


@dataclass
class Tree:
    """A binary tree of balls over distinct weighted points, which ``points`` holds in tree order.

    Node 0 is the root; a ball is the stretch lo..hi of the points; leaves have no children (-1).
    """

    points: np.ndarray
    weights: np.ndarray
    nodes: np.ndarray
    centres: np.ndarray
    sums: np.ndarray


def _anchors(points: np.ndarray) -> np.ndarray:
    """The anchor that owns each point, among about the root of their number.

    A new anchor is the point farthest from its owner. It takes over whoever is nearer to it; who is
    within half the distance between it and the owner cannot be, and is not looked at.
    """

    def far_from(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((p - q) ** 2).sum(axis=1).astype(np.float64))

    owner, distance = np.zeros(len(points), np.int64), far_from(points, points[0])
    anchors = [0]
    while len(anchors) <= math.isqrt(len(points) - 1):
        new = int(distance.argmax())
        if distance[new] == 0:
            break
        between = far_from(points[anchors], points[new])
        near = np.flatnonzero(2 * distance >= between[owner])
        reached = far_from(points[near], points[new])
        taken = near[reached < distance[near]]
        distance[taken] = reached[reached < distance[near]]
        owner[taken] = len(anchors)
        anchors.append(new)
    return owner


def _merged(a: Ball, b: Ball) -> Ball:
    total, count = a.total + b.total, a.count + b.count
    centre = total // count
    radius = max(math.dist(centre, x.centre) + x.radius for x in (a, b)) * (1 + 1e-12)
    return Ball(count, total, centre, radius, None, a, b)


def _above(balls: list[Ball]) -> Ball:
    """One ball over all: those that are each other's tightest partners are merged, again and again."""
    while len(balls) > 1:
        centre, radius = np.array([b.centre for b in balls], np.float64), np.array([b.radius for b in balls])
        wide = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
        np.fill_diagonal(wide, np.inf)
        best = wide.argmin(axis=1).tolist()
        pairs = [(i, j) for i, j in enumerate(best) if i < j and best[j] == i] or [divmod(int(wide.argmin()), len(balls))]
        gone = {i for pair in pairs for i in pair}
        balls = [_merged(balls[i], balls[j]) for i, j in pairs] + [b for i, b in enumerate(balls) if i not in gone]
    return balls[0]


def _below(points: np.ndarray, weights: np.ndarray, index: np.ndarray) -> Ball:
    """The ball of the points at ``index``: anchors, their balls split in the same way, and merged."""
    mine, w = points[index], weights[index]
    if len(index) > _LEAF:
        owner = _anchors(mine)
        if owner.max() > 0:
            return _above([_below(points, weights, index[owner == k]) for k in range(int(owner.max()) + 1)])
    total, count = (mine * w[:, None]).sum(axis=0), int(w.sum())
    centre = total // count
    radius = math.sqrt(float(((mine - centre) ** 2).sum(axis=1).max())) * (1 + 1e-12)
    return Ball(count, total, centre, radius, index)


def grow(points: np.ndarray, weights: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of distinct points, built from the middle outwards, and the place of each point in it."""
    root = _below(points, weights, np.arange(len(points)))
    balls: list[Ball] = []
    into: list[np.ndarray] = []
    links: list[list[int]] = []  # lo, hi, left, right
    filled, stack = 0, [(root, -1, 0)]
    while stack:  # left before right, so that every ball is one stretch of the points
        ball, parent, side = stack.pop()
        at = len(balls)
        balls.append(ball)
        links.append([filled, filled + (0 if ball.index is None else len(ball.index)), -1, -1])
        if parent >= 0:
            links[parent][side] = at
        if ball.index is not None:
            into.append(ball.index)
            filled += len(ball.index)
        else:
            stack += [(ball.right, at, 3), (ball.left, at, 2)]
    for at in range(len(balls) - 1, -1, -1):
        if links[at][2] >= 0:
            links[at][1] = links[links[at][3]][1]
    nodes = np.array([(*link, b.radius, b.count) for link, b in zip(links, balls)], _NODE)
    order = np.concatenate(into)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(points[order], weights[order], nodes, np.array([b.centre for b in balls]), np.array([b.total for b in balls])), place


def settle(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """Gives every point its nearest entry (ties: the first), as whole balls where one entry owns them.

    Level by level a ball inherits its parent's candidate entries and drops those that are farther
    than the best one from all of its points. Yields (nodes, None, entries) of balls with one
    candidate left, and (None, points, entries) of the points of leaves that several could own.
    """
    apart = np.sqrt(squared(entries, entries).astype(np.float64))
    none = np.iinfo(np.int64).max
    node, able = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(node):
        d = squared(tree.centres[node], entries)
        best = np.where(able, d, none).argmin(axis=1)
        gap = d - d[np.arange(len(node)), best][:, None]
        able &= gap <= 2 * tree.nodes["radius"][node][:, None] * apart[best] * (1 + 1e-9) + 1
        owned = able.sum(axis=1) == 1
        yield node[owned], None, best[owned]
        node, able = node[~owned], able[~owned]
        leaf = tree.nodes["left"][node] < 0
        if leaf.any():
            lo, hi = tree.nodes["lo"][node[leaf]], tree.nodes["hi"][node[leaf]]
            points = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
            could = np.repeat(able[leaf], hi - lo, axis=0)
            yield None, points, np.where(could, squared(tree.points[points], entries), none).argmin(axis=1)
        inner, able = node[~leaf], able[~leaf]
        node = np.concatenate([tree.nodes["left"][inner], tree.nodes["right"][inner]]).astype(np.int64)
        able = np.concatenate([able, able])


def _pack(tree: Tree) -> dict[str, bytes]:
    kinds = {"points": "<i4", "weights": "<i4", "nodes": _NODE, "centres": "<i4", "sums": "<i8"}
    return {k: np.ascontiguousarray(getattr(tree, k), kind).tobytes() for k, kind in kinds.items()}


def _unpack(packed: dict[str, bytes], width: int) -> Tree:
    read = lambda k, kind: np.frombuffer(packed[k], kind).astype(np.int64).reshape(-1, width)
    return Tree(read("points", "<i4"), np.frombuffer(packed["weights"], "<i4").astype(np.int64), np.frombuffer(packed["nodes"], _NODE),
                read("centres", "<i4"), read("sums", "<i8"))


_TREE = "struct<points: binary, weights: binary, nodes: binary, centres: binary, sums: binary>"
_TREE_ARROW = pa.struct([(k, pa.binary()) for k in ("points", "weights", "nodes", "centres", "sums")])


def _matrix(vectors: pa.ListArray, length: int) -> np.ndarray:
    """The vectors in steps, one row each; shorter ones end in zeros."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), length), np.int64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = steps(flat)
    return out


def plant(kept: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """Blocks of rows: their vec_id and label, a tree for each part, and every row's place in each tree.

    Each task fills blocks of a fixed number of rows as they come, so memory is bounded and equal
    vectors, however many, are spread as they lie.
    """
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            matrix = _matrix(rows.column("vector").chunk(0), width * parts).reshape(len(rows), parts, width)
            trees, places = [], []
            for p in range(parts):
                points, into, count = np.unique(matrix[:, p], axis=0, return_inverse=True, return_counts=True)
                tree, place = grow(points, count)
                trees.append(_pack(tree))
                places.append(place[into.ravel()].astype("<i4").tobytes())
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).chunk(0))
            return pa.RecordBatch.from_arrays(
                [whole("vec_id"), whole("label"), pa.array([trees], pa.list_(_TREE_ARROW)), pa.array([places], pa.list_(pa.binary()))],
                names=["vec_id", "label", "trees", "places"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, _BLOCK - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == _BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return kept.select("vec_id", "label", "vector").mapInArrow(
        run, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, trees array<{_TREE}>, places array<binary>")


def refine(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round: every entry the floored mean of its points.

    Tasks add up the cached sums of owned balls and of single points; the cluster adds up tasks.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, packed in enumerate(trees.as_py()):
                    tree = _unpack(packed, width)
                    for node, points, entry in settle(tree, books[p]):
                        of, n = (tree.sums[node], tree.nodes["count"][node]) if points is None else (
                            tree.points[points] * tree.weights[points][:, None], tree.weights[points])
                        np.add.at(sums[p], entry, of)
                        np.add.at(counts[p], entry, n)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             *[pa.array(sums[part, entry, i]) for i in range(width)]],
            names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    fields = ", ".join(f"s{i} long" for i in range(width))
    found = blocks.select("trees").mapInArrow(run, f"part int, entry int, n long, {fields}").groupBy("part", "entry")
    out = books.copy()
    for r in found.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row."""
    parts, _, width = books.shape
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                codes, errors = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                places = batch.column(3)[i].as_py()
                for p, packed in enumerate(batch.column(2)[i].as_py()):
                    tree = _unpack(packed, width)
                    code = np.zeros(len(tree.points), np.int64)
                    for node, points, entry in settle(tree, books[p]):
                        if points is not None:
                            code[points] = entry
                        else:
                            for lo, hi, e in zip(tree.nodes["lo"][node], tree.nodes["hi"][node], entry):
                                code[lo:hi] = e
                    error = ((tree.points - books[p][code]) ** 2).sum(axis=1)
                    place = np.frombuffer(places[p], "<i4")
                    codes[:, p] = code[place]
                    errors += error[place]
                digits, n = codes.tobytes().hex(), 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([digits[j:j + n] for j in range(0, len(digits), n)], pa.string()), pa.array(errors)],
                    names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Reads vec_id, embedding and label. Rows whose vector is null or holds null or non-finite
    components are dropped. Components become whole numbers of 1/4096, floored; one beyond 2^15 is
    an error, as its squares would not be exact. Vectors are cut into ``parts`` equal parts; if
    lengths differ, or do not divide, shorter ones end in zeros. Codebooks start as the parts of the
    rows of least vec_id (null ids last, then by vector); with fewer rows they have fewer entries.
    Assignment is exact, ties go to the lower index; unused entries stay. Repeated rows and rows of
    null id or label are coded like any other; the errors of null labels are added up together. A
    table without usable vectors gives no rows.
    """
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    kept = rows.where(fine).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    length = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-length // parts))
    blocks = materialise(plant(kept, width, parts), "vector-trees")
    start = _matrix(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width * parts)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = refine(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialise(assign(blocks, books).withColumn("__label", present(F.col("label"))), "vector-codes")
    totals = coded.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return coded.join(totals, "__label").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
