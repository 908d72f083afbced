"""One document of every group of near copies: BK-trees of SimHash blocks propose pairs, exact Jaccard decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import joining_links, partitions
from plumbline.llm.components import roots
from plumbline.llm.simhash import _LOWER
from plumbline.session import materialise

# Words per shingle, least Jaccard similarity of a link (as a fraction), hash seed.
SHINGLE = 5
LIKE = (4, 5)
SEED = 42
# Share of links at exactly the least similarity that agree on no block of bits.
MISSED = 0.01
# Texts of at most this many shingles also meet by their least shingles, which misses none.
SHORT = 40
_LEAST_BLOCK = 16
_ROWS_PER_VALUE = 4
_SIGHT = 4
_NEAR = 8
# Rows of a part of a crowded block; rows of a subtree that is not split.
CROWD = 2048
_LEAF = 64
_SLICE = 512
_MOST_BITS = 1 << 26
_BLOOM_TASKS = 4
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_FIELDS = ["node", "size", *[f"s{i}" for i in range(_SIGHT)]]
_MEETING = ["shard", "block", *_FIELDS]
_PLACE = ["shard", "block", "lo", "hi"]


def apart(like: float = LIKE[0] / LIKE[1]) -> float:
    """Most that a bit of two fingerprints is expected to differ at this Jaccard similarity."""
    return math.acos(2 * like / (1 + like)) / math.pi


def blocks(n: int) -> tuple[int, int]:
    """Bits of a block and number of blocks, for ``n`` documents.

    Blocks grow with the logarithm of the documents, so that few strangers share one; their number
    grows with them, so that two documents at the least similarity agree on one all the same.
    """
    bits = max(_LEAST_BLOCK, math.ceil(math.log2(max(1, n) / _ROWS_PER_VALUE)))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - apart()) ** bits)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None) -> set[bytes]:
    """Runs of SHINGLE words, in lower case; a shorter text is one, a blank one has none."""
    w = words(text)
    return {b" ".join(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def alike(a: str | None, b: str | None) -> bool:
    """Whether the Jaccard similarity of the shingles is at least LIKE, in whole numbers."""
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both * LIKE[1] >= (len(x) + len(y) - both) * LIKE[0]


def fingerprint(hashes: np.ndarray, longs: int) -> np.ndarray:
    """Majority bits of the distinct shingles' hashes, 64 for each of ``longs`` mixes of a hash."""
    sums = np.zeros(longs * 64, np.int64)
    salt = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # the lanes of a byte hold 255
        x = hashes[at:at + 255, None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        sums += _SPREAD[x.view(np.uint8)].sum(axis=0).view(np.uint8)
    return np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")


def _hashes(w: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of SHINGLE words, ascending."""
    runs = {b" ".join(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64, len(runs)))


def _node(w: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(w))


def _least_shingles(hashes: np.ndarray) -> np.ndarray:
    """Of sorted hashes as many of the least as leave no room for a link that shares none of them."""
    n = len(hashes)
    return hashes[: n - -(-n * LIKE[0] // LIKE[1]) + 1]


def _prints(docs: DataFrame, longs: int) -> DataFrame:
    """doc_id, row_text, node (digest of the words), size, bits and, of short texts, least shingles."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, bits, least = [], [], [], []
            for text in batch.column(2):
                w = words(text.as_py())
                hashes = _hashes(w)
                node.append(_node(w))
                size.append(len(hashes))
                bits.append(fingerprint(hashes, longs).tobytes())
                short = 0 < len(hashes) * LIKE[0] <= SHORT * LIKE[1]
                least.append(_least_shingles(hashes).view(np.int64) if short else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(size, pa.int32()),
                 pa.array(bits, pa.binary()), pa.array(least, pa.list_(pa.int64()))],
                names=["doc_id", "row_text", "node", "size", "bits", "least"])

    return docs.select("doc_id", F.md5("text").alias("row_text"), "text").mapInArrow(
        run, f"doc_id {key}, row_text string, node binary, size int, bits binary, least array<long>")


def _meetings(nodes: DataFrame, width: int, count: int) -> DataFrame:
    """A row for every block of every node: shard (-1 for least shingles), block, and _FIELDS (the node by its id)."""
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                bit = np.unpackbits(raw, axis=1, bitorder="little")[:, : width * count]
                value = bit.reshape(batch.num_rows, count, width).astype(np.int64) @ powers
                least = batch.column(3).to_pylist()
                extra = [len(x) for x in least]
                row = np.concatenate([np.repeat(np.arange(batch.num_rows), count), np.repeat(np.arange(batch.num_rows), extra)])
                shard = np.concatenate([np.tile(np.arange(count, dtype=np.int32), batch.num_rows), np.full(sum(extra), -1, np.int32)])
                block = np.concatenate([value.ravel(), np.array([h for x in least for h in x], np.int64)])
                sight = np.ascontiguousarray(raw[:, : 8 * _SIGHT]).view("<i8")
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(block), batch.column(0).take(take), batch.column(1).take(take),
                     *[pa.array(sight[row, i]) for i in range(_SIGHT)]], names=["shard", "block", *_FIELDS])

    sights = ", ".join(f"s{i} long" for i in range(_SIGHT))
    return nodes.select("id", "size", "bits", "least").mapInArrow(run, f"shard int, block long, node long, size int, {sights}")


def _bounds(size: np.ndarray) -> np.ndarray:
    """Most differing bits of sight at which two nodes, the smaller of ``size``, are checked."""
    bits = 64 * _SIGHT
    rate = np.where(size > SHORT, apart(), 0.25)  # majorities of few shingles flip more easily
    return rate * bits + 4 * np.sqrt(bits * rate * (1 - rate))


def _close(sight: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits of the pairs, and whether they and the sizes allow a link."""
    d = np.bitwise_count(sight[i] ^ sight[j]).sum(axis=1, dtype=np.int64)
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return d, (d <= _bounds(small)) & (small * LIKE[1] >= large * LIKE[0])


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class Tree:
    """A BK-tree of fingerprints: the children of a row are keyed by their Hamming distance to it.

    Rows are kept in the order of the tree, so a subtree is a stretch of rows. A subtree of a few
    rows is not split, and neither are equal rows.
    """

    def __init__(self, bits: np.ndarray):
        self.order = np.arange(len(bits))
        self.children: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the row at this place: edges, and where children begin and the last one ends
        stack = [(0, len(bits))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= _LEAF:
                continue
            rest = self.order[lo + 1:hi]
            edge = _distance(bits[rest], bits[self.order[lo]])
            by = np.argsort(edge, kind="stable")
            self.order[lo + 1:hi] = rest[by]
            edges, first = np.unique(edge[by], return_index=True)
            starts = np.append(lo + 1 + first, hi)
            self.children[lo] = edges, starts
            stack += [(a, b) for e, a, b in zip(edges.tolist(), starts.tolist(), starts[1:].tolist()) if e]
        self.bits = bits[self.order]

    def within(self, bits: np.ndarray, radius: float) -> np.ndarray:
        """The rows that differ from ``bits`` in at most ``radius`` of them."""
        seen, stack = [], [(0, len(self.order))]
        while stack:
            lo, hi = stack.pop()
            if lo not in self.children:
                seen.append(np.arange(lo, hi))
                continue
            edges, starts = self.children[lo]
            seen.append(np.array([lo]))
            d = int(np.bitwise_count(self.bits[lo] ^ bits).sum(dtype=np.int64))
            first, end = np.searchsorted(edges, d - radius), np.searchsorted(edges, d + radius, side="right")
            stack += zip(starts[first:end].tolist(), starts[first + 1:end + 1].tolist())
        at = np.concatenate(seen)
        return self.order[at[_distance(self.bits[at], bits) <= radius]]


def _pairs(node: pa.Array, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    return [node.take(pa.array(i)), node.take(pa.array(j))]


def _columns(table: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() if isinstance(table, pa.Table) else table.column(n).to_numpy(zero_copy_only=False) for n in names]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) within the blocks, which come sorted, and the rows of crowded blocks.

    The first row of a block is the root of its BK-tree, with the others as children: rows whose edges
    differ by more than the bound are not compared. The rows of a small block meet all before them. A
    block of more rows is crowded: a row is paired with the nearest of the rows just before it, and all its rows are
    given on, each with its pair, so that nobody has to look for them again. A crowded block thus gives
    no more rows than it has, and the few pairs of its first if a batch ends there. Only a few rows are held, however large a block is.
    """
    tail, first_rank, first_root = None, 0, np.zeros(_SIGHT, np.uint64)
    most = _bounds(np.zeros(1))[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
        old = 0 if tail is None else tail.num_rows
        shard, block, size = _columns(rows, "shard", "block", "size")
        sight = np.stack(_columns(rows, *_FIELDS[2:]), axis=1).view(np.uint64)  # bits of negative numbers are counted otherwise
        at = np.arange(len(shard))
        new = np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(block) != 0)])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = at - start + np.where(start == 0, first_rank, 0)
        top = sight[start]
        if first_rank:
            top[start == 0] = first_root
        edge = _distance(sight, top)
        crowded = np.zeros(len(at), bool)
        crowded[start[rank > _NEAR]] = True
        crowded = crowded[start]
        a, b, best = [], [], np.full(len(at), 1 << 30)
        partner = np.zeros(len(at), np.int64)
        for lag in range(1, _NEAR + 1):
            j = at[(at >= max(old, lag)) & (at - lag >= start)]
            j = j[np.abs(edge[j] - edge[j - lag]) <= most]
            d, ok = _close(sight, size, j - lag, j)
            j, d = j[ok], d[ok]
            few = ~crowded[j]
            a.append(j[few] - lag)
            b.append(j[few])
            j, d = j[~few], d[~few]
            nearer = d < best[j]
            best[j[nearer]], partner[j[nearer]] = d[nearer], j[nearer] - lag
        left, right = np.concatenate(a), np.concatenate(b)
        node = rows.column("node").combine_chunks()
        node = node.chunk(0) if isinstance(node, pa.ChunkedArray) else node
        yield pa.RecordBatch.from_arrays(
            [*_pairs(node, left, right), *[pa.nulls(len(left), f.type) for f in rows.schema]], names=["a", "b", *_MEETING])
        # The first row beyond _NEAR brings those before it along; all of them are still held.
        member = (rank > _NEAR) & (at >= old)
        first = np.flatnonzero((rank == _NEAR + 1) & (at >= old))
        for lag in range(1, _NEAR + 2):
            member[first - lag] = True
        members = rows.filter(pa.array(member)).combine_chunks()
        chosen, lone = np.flatnonzero(member), best[member] == 1 << 30
        pair = [pa.array(node.to_numpy(zero_copy_only=False)[x], mask=lone) for x in (partner[chosen], chosen)]
        yield pa.RecordBatch.from_arrays([*pair, *[members.column(n).combine_chunks() for n in _MEETING]], names=["a", "b", *_MEETING])
        keep = max(0, len(at) - _NEAR - 1)
        first_rank, first_root = int(rank[keep]), top[keep]
        tail = rows.slice(keep).to_batches()[0]


def _candidates(sight: np.ndarray, size: np.ndarray, group: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a crowded block, each with the rows of other groups that its BK-tree and the sizes allow.

    ``group`` may change on the way. Every pair comes once, from a row outside the largest group; of
    two parts of a block only pairs across them.
    """
    tree, done, two = Tree(sight), np.zeros(len(group), bool), part.min() != part.max()
    reach = _bounds(size * LIKE[0] // LIKE[1])
    for i in np.flatnonzero(group != np.bincount(group).argmax()).tolist():
        j = tree.within(sight[i], reach[i])
        j = j[(group[j] != group[i]) & ~done[j]]
        j = j[part[j] != part[i]] if two else j
        j = j[_close(sight, size, np.full(len(j), i), j)[1]]
        done[i] = True
        if len(j):
            yield i, j


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one pair of parts of a block at a time; they come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack(_columns(batch, *_PLACE), axis=1)
        edges = (np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist()
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            key = tuple(keys[lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _facts(rows: pa.Table) -> list[np.ndarray]:
    """Bits of sight, sizes, groups by number and parts."""
    size, root, part = _columns(rows, "size", "root", "part")
    sight = np.stack(_columns(rows, *_FIELDS[2:]), axis=1).view(np.uint64)  # bits of negative numbers are counted otherwise
    return [sight, size.astype(np.int64), np.unique(root, return_inverse=True)[1], part]


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of crowded blocks that may link with a row of another group."""
    for rows in _crowds(batches):
        found = np.zeros(len(rows), bool)
        for i, j in _candidates(*_facts(rows)):
            found[i] = found[j] = True
        yield from rows.filter(pa.array(found)).to_batches()


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the groups of each crowded block, by the rows' whole sets."""

    def linked(n: int, m: np.ndarray, both: np.ndarray) -> np.ndarray:
        return both * LIKE[1] >= (n + m - both) * LIKE[0]

    for rows in _crowds(batches):
        sight, size, group, part = _facts(rows)
        sets = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("found")]
        (node,) = _columns(rows, "node")
        links = list(joining_links(sets, group, _candidates(sight, size, group, part), linked))
        a, b = ([x[i] for x in links] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (a, b)], names=["a", "b"])


def _crowded_links(docs: DataFrame, nodes: DataFrame, crowded: DataFrame, rooted: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b) that join all groups of linked texts which meet in a crowded block.

    Blocks whose rows are one group already are left out. Of the others a BK-tree each finds the rows
    that may have a partner in another group; only these get their sets of shingles, by which the
    same trees then decide on the spot, so that links leave a task and not candidates. Large blocks
    are parts, and every pair of parts is a task's.
    """
    inside = _with_roots(crowded, rooted)
    counted = inside.groupBy("shard", "block").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed"))
    parts = counted.where("mixed").select("shard", "block", (F.floor(F.col("n") / CROWD) + 1).cast("int").alias("parts"))
    inside = inside.join(parts, ["shard", "block"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    inside = inside.select(*_PLACE, "part", *_FIELDS, "root")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, *_PLACE).sortWithinPartitions(*_PLACE, "node")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside.schema)
    some = materialise(dealt(inside).mapInArrow(_undecided, fields), "copies-undecided")
    texts = _texts(docs, nodes, some.select(F.col("node").alias("id")).distinct())
    rows = some.join(texts.select("id", "text").mapInArrow(_sets, "node long, found binary"), "node")
    return dealt(rows.select(*some.columns, "found")).mapInArrow(_joining, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([_hashes(words(x.as_py())).tobytes() for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "found"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _places(nodes: list[bytes], bits: int) -> np.ndarray:
    """For each node the bits of a Bloom filter it sets."""
    h = np.frombuffer(b"".join(nodes), "<u8").reshape(-1, 2)
    return ((h[:, :1] + h[:, 1:] * np.arange(1, 4, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes, of 16 bits for each and 8 MB at most; a fuller one lets more pass."""
    bits = min(_MOST_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits, bool)
        for batch in batches:
            if batch.num_rows:
                found[_places(batch.column(0).to_pylist(), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["bits"])

    parts = wanted.select("node").repartition(_BLOOM_TASKS).mapInArrow(run, "bits binary").collect()
    return np.unpackbits(np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in parts])).astype(bool)


def _texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the nodes of these ids.

    A Bloom filter of the wanted nodes keeps most other texts out of the exchange; the join decides.
    """
    wanted = materialise(nodes.select("id", "node").join(ids, "id"), "copies-wanted")
    bloom = _bloom(wanted)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_node(words(x.as_py())) for x in batch.column(0)]
            if found:
                some = pa.array(bloom[_places(found, len(bloom))].all(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0)], names=["node", "text"]).filter(some)

    named = docs.select("text").mapInArrow(name, "node binary, text string").join(wanted, "node")
    return materialise(named.groupBy("id").agg(F.min("text").alias("text")), "copies-texts")


def _checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids of nodes whose texts have a Jaccard similarity of at least LIKE."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([alike(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)

    texts = _texts(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _with_roots(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    return nodes.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_text (MD5 of the text) and root (long, the same in all rows of a group).

    Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more;
    groups are what links connect. Texts of equal words are one node; blank and null texts are one.
    Fingerprints that agree on a block of bits meet in its BK-tree; a pair is linked only after an
    exact check. Crowded blocks are joined in two steps: each row with one neighbour, and then, in
    full, the rows that are not in one group yet. A large group thus gives links for its rows, not
    for its pairs, also if its rows are alike but not linked.
    """
    n = docs.count()
    width, count = blocks(n)
    prints = materialise(_prints(docs, max(_SIGHT, math.ceil(width * count / 64))), "copies-prints")
    nodes = prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("size", "bits", "least")])
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "copies-nodes")
    tasks = max(partitions(docs.sparkSession), math.ceil(n * count / 500_000))
    met = _meetings(nodes, width, count).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "node")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema)
    found = materialise(met.mapInArrow(_neighbours, f"a long, b long, {fields}"), "copies-found")
    pairs = materialise(_ordered(found.where("a is not null").select("a", "b")), "copies-pairs")
    links = materialise(_checked(docs, nodes, pairs), "copies-links")
    rooted = roots(links)
    crowded = found.where("shard is not null").select(*_MEETING)
    if crowded.head(1):
        more = materialise(_crowded_links(docs, nodes, crowded, rooted, tasks), "copies-links")
        rooted = roots(links.unionByName(more))
    named = _with_roots(nodes.select(F.col("id").alias("node"), F.col("node").alias("digest")), rooted)
    rows = prints.select("doc_id", "row_text", F.col("node").alias("digest"))
    return rows.join(named, "digest").select("doc_id", "row_text", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group of :func:`near_rows`: that of the least doc_id, then of the least row_text.

    All columns stay. Rows without an id stay, as nothing tells them apart from others. Of rows of
    equal id and text the one with the least columns stays.
    """
    rows = materialise(near_rows(docs), "copies-rows")
    key = F.struct("doc_id", "row_text")
    kept = rows.where("doc_id is not null").groupBy("root").agg(F.min(key).alias("k"), F.count("*").alias("n"))
    kept = kept.select(F.col("k.doc_id").alias("__kept_id"), F.coalesce("k.row_text", F.lit("")).alias("__kept_text"))
    kept = materialise(kept, "copies-kept")
    # The ids grow with the documents: a merge join at every size, so that cost grows evenly.
    same = (F.col("doc_id") == F.col("__kept_id")) & (F.coalesce(F.md5("text"), F.lit("")) == F.col("__kept_text"))
    found = docs.where("doc_id is not null").join(kept.hint("merge"), same, "left_semi")
    again = rows.where("doc_id is not null").groupBy("doc_id", "row_text").count().where("count > 1")
    if again.head(1):
        found = found.groupBy("doc_id", F.md5("text").alias("__text")).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return found.unionByName(docs.where("doc_id is null"))
