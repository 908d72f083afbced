"""Jaccard join of shingle sets: subsets of small sets, inverted lists for large ones, a boundary by cost."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import joining_links, partitions
from plumbline.llm.components import roots
from plumbline.session import materialise_and_clear as materialise

# Words per shingle, least Jaccard similarity of a link (as a fraction).
SHINGLE = 3
LIKE = (90, 100)
# Largest boundary that is weighed; subsets of larger sets are never worth it.
MOST_SMALL = 40
_SLOTS = 1 << 20
_CHUNK = 1 << 16
_SALTS = 16
_HELD = 1 << 20
_SLAB = 1 << 20
# Rows of a list that meet all others at once; rows of a block of a crowded list.
NEAR = 8
CROWD = 4096
_MAP = 4  # longs of a parity map
_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def need(n, m):
    """Least number of elements that linked sets of these sizes have in common."""
    return -(-LIKE[0] * (n + m) // (LIKE[0] + LIKE[1]))


def smallest(n):
    """Size of the smallest set that a set of size n can link with; linked sets share that many at least."""
    return -(-LIKE[0] * n // LIKE[1])


def prefix(n):
    """Of elements in one order for all sets, how many of the first two linked sets cannot both avoid."""
    return n - smallest(n) + 1


def subset_sizes(n: int) -> list[int]:
    """The overlaps that a set of size n needs with sets of any size it can link with."""
    return sorted({need(n, m) for m in range(smallest(n), n * LIKE[1] // LIKE[0] + 1)})


def _mix(x: np.ndarray, step: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's runs of SHINGLE words, ascending; a shorter text is one run."""
    text, at, parts = (text or b"").translate(_WORDS), 0, []
    while at < len(text):
        end = text.find(b" ", at + _SLAB)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    found = words[:n]
    for i in range(1, k):
        found = _mix(found, i) + words[i:i + n]
    return np.unique(_mix(found))


def map_bits(n: int) -> int:
    """Bits of a set's wide parity map: a power of two that leaves unrelated sets many differing bits."""
    return max(64 * _MAP, 1 << max(0, n // 2 - 1).bit_length())


def _parity(elements: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _differing(x: bytes, y: bytes) -> int:
    """Differing bits of two wide maps; the longer one is folded to the length of the other."""
    a, b = (np.frombuffer(z, "<u8") for z in sorted((x, y), key=len))
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for text in column.cast(pa.binary()):
        yield shingles(text.as_py())


def _slots(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - int(math.log2(_SLOTS)))).astype(np.int64)


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall in each of a fixed number of slots.

    Tasks count into an array; arrays are added up on the cluster, chunk by chunk, in two steps.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(_SLOTS, np.int64), [], 0
        for batch in batches:
            for found in _texts(batch.column(0)):
                held.append(_slots(found))
                n += len(found)
                if n > _HELD:
                    total += np.bincount(np.concatenate(held), minlength=_SLOTS)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=_SLOTS)
        salt = TaskContext.get().partitionId() % _SALTS
        for i in range(_SLOTS // _CHUNK):
            part = total[i * _CHUNK:(i + 1) * _CHUNK]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.astype("<u4").tobytes()])],
                names=["chunk", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(2)):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        for i, total in sums.items():  # beyond 32 bits order does not matter any more
            total = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([total])], names=["chunk", "salt", "counts"])

    kind = "chunk int, salt int, counts binary"
    chunks = _SLOTS // _CHUNK
    counted = docs.select("text").mapInArrow(count, kind).repartition(chunks * _SALTS, "chunk", "salt").mapInArrow(add, kind)
    out = np.zeros(_SLOTS, np.int64)
    added = materialise(counted.repartition(chunks, "chunk").mapInArrow(add, kind), "jaccard-counts")
    for r in added.collect():
        out[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], "<u4")
    return out


def _sets(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for every row of ``docs``: doc_id, text_key, digest of the set, size, two parity maps and elements.

    Elements come in one order for all sets, rare slots first; of a large set only the prefix is
    kept. With each comes the number of blocks its list is dealt out to, and the sum of the
    lengths its lists may have. A parity map has a bit for each of some classes of elements, on if
    the set has an odd number of them: two maps differ in no more bits than the sets in elements.
    The short one, of 256 bits, goes into the lists; the wide one has about half a bit an element.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    load = counts.sum() / _SLOTS
    order = counts.astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, maps, wide, kept, blocks, scan = [], [], [], [], [], [], []
            for found in _texts(batch.column(2)):
                n = len(found)
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                size.append(n)
                maps.append(_parity(found, 64 * _MAP).view("<i8"))
                wide.append(_parity(found, map_bits(n)).tobytes())
                slot = order[_slots(found)]
                first = np.lexsort((found, slot))[: n if n <= smallest_of_large() else prefix(n)] if n else np.zeros(0, np.int64)
                lengths = np.maximum(slot[first] - load, 0)
                kept.append(found[first].view(np.int64))
                blocks.append((lengths // CROWD).astype(np.int32) + 1)
                scan.append(float((1 + lengths[: prefix(n)]).sum()) if n else 0.0)
            maps = np.array(maps, np.int64).reshape(len(size), _MAP)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int32()),
                 *[pa.array(maps[:, i]) for i in range(_MAP)], pa.array(wide, pa.binary()), pa.array(kept, pa.list_(pa.int64())),
                 pa.array(blocks, pa.list_(pa.int32())), pa.array(scan, pa.float64())],
                names=["doc_id", "text_key", "digest", "size", *_MAPS, "wide", "elements", "blocks", "scan"])

    fields = ", ".join(f"{m} long" for m in _MAPS)
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key long, digest binary, size int, {fields}, wide binary, elements array<long>, blocks array<int>, scan double")


_MAPS = [f"m{i}" for i in range(_MAP)]


def smallest_of_large() -> int:
    """Sets up to this size are kept whole, as the boundary may turn out to lie there."""
    return MOST_SMALL * LIKE[1] // LIKE[0]


def boundary(sizes: dict[int, tuple[int, float]]) -> int:
    """The size up to which sets are small, from the number of sets of each size and their lists' lengths.

    A small set costs a row for each of its subsets; a large set, and a small one that can link with
    a large one, costs the rows of its lists.
    """

    def cost(x: int) -> float:
        subsets = sum(n * sum(math.comb(s, c) for c in subset_sizes(s)) for s, (n, _) in sizes.items() if s <= x)
        return subsets + sum(scan for s, (_, scan) in sizes.items() if s >= smallest(x + 1))

    return min(range(MOST_SMALL + 1), key=cost)


def _subset_links(small: DataFrame) -> DataFrame:
    """Links (a, b) that join all linked small sets: a and b have a subset of the needed size in common.

    Subsets of one size with equal hash are one group. Its smallest set is linked with every other
    that it needs no more elements for; a set that needs more for it needs more for all others too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for node, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.array(found.as_py(), np.int64).view(np.uint64)
                both = [_mix(found, 11), _mix(found, 12)]
                for c in subset_sizes(len(found)):
                    left_out = np.array(list(itertools.combinations(range(len(found)), len(found) - c)), np.int64)
                    for column, hashes in zip(out[:2], both):
                        column.append((hashes.sum() - hashes[left_out].sum(axis=1, dtype=np.uint64)).view(np.int64))
                    for column, value in zip(out[2:], (c, len(found), node)):
                        column.append(np.full(len(left_out), value, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=["x", "y", "c", "size", "node"])

    keyed = materialise(small.select("node", "elements").mapInArrow(run, "x long, y long, c long, size long, node long"), "jaccard-subsets")
    first = keyed.groupBy("x", "y", "c").agg(F.min(F.struct("size", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    fits = (LIKE[0] + LIKE[1]) * F.col("c") >= LIKE[0] * (F.col("size") + F.col("first.size"))
    return keyed.join(first, ["x", "y", "c"]).where(fits & (F.col("node") != F.col("first.node"))).select(
        F.col("node").alias("a"), F.col("first.node").alias("b"))


def _postings(nodes: DataFrame) -> DataFrame:
    """A row for every element of every set's prefix: element, blocks of its list, block, node, size, map."""
    size = F.col("size")
    count = size - F.floor((size * LIKE[0] + LIKE[1] - 1) / LIKE[1]).cast("int") + 1
    both = F.slice(F.arrays_zip("elements", "blocks"), F.lit(1), count)
    rows = nodes.select("node", "size", *_MAPS, F.explode(both).alias("e"))
    block = F.pmod(F.xxhash64("node"), F.col("e.blocks")).cast("int")
    return rows.select(F.col("e.elements").alias("element"), F.col("e.blocks").alias("blocks"), block.alias("block"), "node", "size", *_MAPS)


def _could(maps: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits of the pairs' maps, and whether maps and sizes leave room for a link."""
    d = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
    n, m = size[i], size[j]
    return d, (d <= n + m - 2 * need(n, m)) & (np.minimum(n, m) >= smallest(np.maximum(n, m)))


def _arrays(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy() for n in names]


_POSTING = ["element", "blocks", "block", "node", "size", *_MAPS]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) within lists, which come sorted, and the postings of crowded lists.

    The first rows of a list meet all before them. A later one is paired with the likest of the few
    just before it; such a list is crowded, and all its postings are given on. Only the last few
    rows are held.
    """
    tail, ranked = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
        old = 0 if tail is None else tail.num_rows
        element, block, node, size, blocks = _arrays(rows, "element", "block", "node", "size", "blocks")
        size, maps = size.astype(np.int64), np.stack(_arrays(rows, *_MAPS), axis=1).view(np.uint64)
        at = np.arange(len(element))
        start = np.maximum.accumulate(np.where(np.r_[True, (np.diff(element) != 0) | (np.diff(block) != 0)], at, 0))
        rank = at - start + np.where(start == 0, ranked, 0)
        pairs, best, partner = [], np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
        for lag in range(1, NEAR + 1):
            j = at[(at >= max(old, lag)) & (at - lag >= start)]
            d, able = _could(maps, size, j - lag, j)
            j, d = j[able], d[able]
            few = rank[j] <= NEAR
            pairs.append((j[few] - lag, j[few]))
            j, d = j[~few], d[~few]
            nearer = d < best[j]
            best[j[nearer]], partner[j[nearer]] = d[nearer], j[nearer] - lag
        late = np.flatnonzero(best < np.iinfo(np.int64).max)
        a, b = (np.concatenate(x) for x in zip(*pairs, (partner[late], late)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[a]), pa.array(node[b]), *[pa.nulls(len(a), f.type) for f in rows.schema]], names=["a", "b", *_POSTING])
        # The first row beyond NEAR brings those before it along; all of them are still held.
        new = np.flatnonzero((rank == NEAR + 1) & (at >= old))
        member = (blocks > 1) & (at >= old) | (rank > NEAR) & (at >= old)
        for lag in range(1, NEAR + 2):
            member[new[blocks[new] == 1] - lag] = True
        members = rows.filter(pa.array(member)).combine_chunks()
        none = pa.nulls(len(members), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *[members.column(n).combine_chunks() for n in _POSTING]], names=["a", "b", *_POSTING])
        keep = max(0, len(at) - NEAR - 1)
        ranked = int(rank[keep])
        tail = rows.slice(keep).to_batches()[0]


_PLACE = ["element", "lo", "hi"]
_MEMBER = [*_PLACE, "block", "node", "size", "root", *_MAPS]


def _candidates(block: np.ndarray, size: np.ndarray, group: np.ndarray, maps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a pair of blocks, each with the rows of other groups that parity maps and sizes allow.

    ``group`` may change on the way. Every pair comes once, from a row outside the largest group; of
    two blocks only pairs across them.
    """
    done, two = np.zeros(len(group), bool), block.min() != block.max()
    for i in np.flatnonzero(group != np.bincount(group).argmax()).tolist():
        j = np.flatnonzero((group != group[i]) & ~done)
        j = j[block[j] != block[i]] if two else j
        j = j[_could(maps, size, np.full(len(j), i), j)[1]]
        done[i] = True
        if len(j):
            yield i, j


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one pair of blocks of a list at a time; they come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in _PLACE], axis=1)
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
    """Blocks, sizes, groups by number and parity maps."""
    block, size, root = _arrays(rows, "block", "size", "root")
    maps = np.stack(_arrays(rows, *_MAPS), axis=1).view(np.uint64)
    return [block, size.astype(np.int64), np.unique(root, return_inverse=True)[1], maps]


class _WideMaps:
    """Wide parity maps of the rows of a list, those of one length as a matrix."""

    def __init__(self, column: pa.ChunkedArray):
        maps = [np.frombuffer(x.as_py(), "<u8") for x in column]
        self.length = np.array([len(x) for x in maps])
        self.place, self.matrix = np.zeros(len(maps), np.int64), {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.matrix[n] = np.stack([maps[k] for k in at.tolist()])

    def differing(self, i: int, j: np.ndarray) -> np.ndarray:
        """Differing bits of the maps of a row and of several; longer ones are folded."""
        mine, out = self.matrix[int(self.length[i])][self.place[i]], np.zeros(len(j), np.int64)
        for n in np.unique(self.length[j]).tolist():
            at, k = np.flatnonzero(self.length[j] == n), min(n, len(mine))
            others = np.bitwise_xor.reduce(self.matrix[n][self.place[j[at]]].reshape(len(at), -1, k), axis=1)
            out[at] = np.bitwise_count(others ^ np.bitwise_xor.reduce(mine.reshape(-1, k), axis=0)).sum(axis=1)
        return out


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of crowded lists that may link with a row of another group, by short maps, or by wide ones if they come along."""
    for rows in _lists(batches):
        block, size, group, maps = _facts(rows)
        wide = _WideMaps(rows.column("wide")) if "wide" in rows.column_names else None
        found = np.zeros(len(rows), bool)
        for i, j in _candidates(block, size, group, maps):
            if wide:
                j = j[wide.differing(i, j) <= size[i] + size[j] - 2 * need(size[i], size[j])]
            found[i] |= len(j) > 0
            found[j] = True
        yield from rows.select(_MEMBER).filter(pa.array(found)).to_batches()


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the groups in each pair of blocks of a list, by whole sets."""

    def linked(n: int, m: np.ndarray, both: np.ndarray) -> np.ndarray:
        return both >= need(n, m)

    for rows in _lists(batches):
        block, size, group, maps = _facts(rows)
        sets = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("found")]
        node = rows.column("node").to_numpy()
        links = list(joining_links(sets, group, _candidates(block, size, group, maps), linked))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[np.array([x[k] for x in links], np.int64)]) for k in (0, 1)], names=["a", "b"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _id(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def _whole(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and found (its whole set) of the nodes in ``wanted``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([x.tobytes() for x in _texts(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "found"])

    wanted = nodes.select("node", _id().alias("__id"), "text_key").join(wanted, "node")
    texts = docs.select(_id().alias("__id"), F.xxhash64("text").alias("text_key"), "text").join(wanted, ["__id", "text_key"])
    found = texts.select("node", "text").mapInArrow(whole, "node long, found binary")
    return materialise(found.groupBy("node").agg(F.min("found").alias("found")), "jaccard-whole")


def _checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of at least LIKE."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_differing(x.as_py(), y.as_py()) <= n + m - 2 * need(n, m) for n, x, m, y in zip(
                batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), "<u8") for z in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                good.append(int((both[1:] == both[:-1]).sum()) >= need(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    maps = nodes.select("node", "size", "wide")
    both = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b")
    pairs = materialise(both.select("a", "b", "n", "x", "m", "y").mapInArrow(possible, "a long, b long"), "jaccard-possible")
    found = _whole(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(
        found.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _list_links(docs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and those that join all groups of linked sets which have a posting in a common list."""
    posts = _postings(nodes)
    tasks = partitions(docs.sparkSession)
    met = posts.repartition(tasks, "element", "block").sortWithinPartitions("element", "block", "size", "node")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in posts.schema)
    found = materialise(met.mapInArrow(_scan, f"a long, b long, {fields}"), "jaccard-found")
    pairs = materialise(_ordered(found.where("a is not null").select("a", "b")), "jaccard-pairs")
    links = materialise(links.unionByName(_checked(docs, nodes, pairs)), "jaccard-links")
    crowded = found.where("a is null").select(*posts.columns)
    if not crowded.head(1):
        return links
    inside = crowded.join(roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = materialise(inside, "jaccard-crowded")
    mixed = inside.groupBy("element").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("element")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    inside = inside.join(mixed, "element", "left_semi").withColumn("other", other).withColumns(
        {"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, *_PLACE).sortWithinPartitions(*_PLACE, "node")

    inside = inside.select(*_MEMBER)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside.schema)
    some = materialise(dealt(inside).mapInArrow(_undecided, fields), "jaccard-undecided")
    # The short maps of large sets say little; wide ones spare most of what is left its whole set.
    some = some.join(nodes.select("node", "wide"), "node").select(*_MEMBER, "wide")
    some = materialise(dealt(some).mapInArrow(_undecided, fields), "jaccard-open")
    rows = some.join(_whole(docs, nodes, some.select("node").distinct()), "node").select(*_MEMBER, "found")
    more = materialise(dealt(rows).mapInArrow(_joining, "a long, b long"), "jaccard-joining")
    return links.unionByName(more)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included).

    Reads doc_id and text. A set holds the distinct 3-word shingles of a text, A-Z in lower case; a
    text of fewer words is one shingle, a null, empty or blank text has none and links with nothing.
    Shingles are told apart by 64-bit hashes. Two rows link if 100 * common >= 90 * all shingles.

    Equal sets are one node. Small sets are joined through subsets of the sizes they need in common;
    large ones, and small ones that can link with them, through inverted lists of their rarest
    elements, after which candidates are held against each other in full. The boundary is where both
    cost least. Links join groups but are not listed in full: in a crowded list every set meets its
    likest neighbour, and then only sets of different groups meet, block by block, where their whole
    sets decide on the spot: links leave a task, not candidates.

    Null ids never name a component of others; repeated rows get a row each; an empty table gives
    none. Texts are read a stretch at a time, at any length.
    """
    rows = materialise(_sets(docs, slot_counts(docs)).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    names = rows.where("size > 0").groupBy("digest").agg(F.min(first).alias("first"), F.min("doc_id").alias("least"))
    names = materialise(names.select("digest", F.col("first.row").alias("node"), "least"), "jaccard-names")
    nodes = materialise(rows.drop("digest").join(names.select("node"), F.col("row") == F.col("node")).drop("row"), "jaccard-nodes")
    sizes = nodes.where(F.col("size") <= smallest_of_large()).groupBy("size").agg(F.count("*").alias("n"), F.sum("scan").alias("scan"))
    small = boundary({r["size"]: (r["n"], r["scan"]) for r in sizes.collect()})
    links = _subset_links(nodes.where(F.col("size") <= small))
    links = _list_links(docs, nodes.where(F.col("size") >= smallest(small + 1)), links)
    rooted = names.join(roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "component_id")
    out = rows.select("doc_id", "digest", F.col("size").cast("long").alias("n_shingles")).join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
