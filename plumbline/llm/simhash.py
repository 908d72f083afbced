"""SimHash fingerprints and near-duplicate groups found through BK-trees."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions
from plumbline.llm.components import roots
from plumbline.session import materialise

# Fixed values of the fingerprint: words per shingle, hash seed, most differing bits of a link.
SHINGLE = 4
SEED = 42
RADIUS = 4
_BITS = 64
_SLAB = 1 << 16
_TREE = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """64 majority bits of the XXH64 hashes of the text's word shingles, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1:]
    counts = np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLAB):
        spans = zip(starts[at:min(n, at + _SLAB)].tolist(), last[at:at + _SLAB].tolist())
        hashes = np.array([digest(flat[s:e], SEED) for s, e in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (long) of every row; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fingerprint"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fingerprint long")


class Tree:
    """A BK-tree of leaders: children are keyed by their Hamming distance to the parent.

    A fingerprint within the radius of a leader joins it as a member instead of becoming a node, so
    a crowd of near copies is few nodes. Links are found by following only the edges within twice
    the radius: whoever is linked to a member is that near to its leader. Members of a leader that
    is already in the same component are not compared. ``parent`` holds the components.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.members: list[list[int]] = []
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, value: int) -> int | None:
        """Insert a fingerprint; the leader it belongs to, or None if it became one itself."""
        r, home, far = self.radius, -1, []
        stack = [0] if self.values else []
        tail = -1
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= r:
                if home < 0:
                    home = node
                else:
                    self.parent[self.find(node)] = self.find(home)
            elif d <= 2 * r:
                far.append(node)
            kids = self.children[node]
            if kids:
                for edge, child in kids.items():
                    if d - 2 * r <= edge <= d + 2 * r:
                        stack.append(child)
        new = home < 0
        if new:
            home = len(self.values)
            if home:
                node = 0
                while True:
                    d = (self.values[node] ^ value).bit_count()
                    tail = self.children[node].get(d, -1)
                    if tail < 0:
                        self.children[node][d] = home
                        break
                    node = tail
            self.values.append(value)
            self.children.append({})
            self.members.append([])
            self.parent.append(home)
        else:
            self.members[home].append(value)
        root = self.find(home)
        for node in far:
            other = self.find(node)
            if other != root and any((m ^ value).bit_count() <= r for m in self.members[node]):
                self.parent[other] = root
        return None if new else home


def _forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join the components among ``values``: each to its leader, leaders to their root."""
    tree = Tree(radius)
    for value in values:
        leader = tree.add(value)
        if leader is not None:
            yield value, tree.values[leader]
    for i, value in enumerate(tree.values):
        root = tree.find(i)
        if root != i:
            yield value, tree.values[root]


def agreeing_blocks(n: int, radius: int = RADIUS) -> list[tuple[tuple[int, int], ...]]:
    """Ways to choose the bit blocks on which two fingerprints within the radius must agree.

    64 bits in ``radius + m`` blocks: at most ``radius`` blocks differ, so some m agree. The least m
    that leaves few fingerprints to a choice of block values is taken; every m finds all links.
    """
    m = 1
    while m < 4 and n / 2 ** (_BITS * m / (radius + m)) > _TREE:
        m += 1
    edges = [round(_BITS * i / (radius + m)) for i in range(radius + m + 1)]
    return list(itertools.combinations(list(zip(edges, edges[1:])), m))


def _block_keys(value: Column, choices: list[tuple[tuple[int, int], ...]]) -> Column:
    masks = [sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in choice) for choice in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[
        F.struct(F.lit(i).alias("shard"), value.bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(signed)])


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fingerprint``) that join all components.

    Fingerprints that agree on a choice of blocks are a shard; a BK-tree is built for each shard
    where its rows are, and every fingerprint searches it. Trees are not broadcast, as they grow with
    the data: a fingerprint travels to the few shards that can hold its partners. All fingerprints
    within the radius share a shard. Each shard gives a spanning forest, never all pairs.
    """
    n = values.count()
    choices = agreeing_blocks(n, radius)
    keyed = values.select("fingerprint", F.explode(_block_keys(F.col("fingerprint"), choices)).alias("k")).select(
        "k.shard", "k.block", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[int]) -> pa.RecordBatch:
            found = list(_forest(group, radius))
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        held: list[int] = []
        at: tuple | None = None
        for batch in batches:
            shard, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            value = batch.column(2).to_pylist()
            if not value:
                continue
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(value)]):
                key = (shard[lo], block[lo])
                if key != at:
                    if len(held) > 1:
                        yield out(held)
                    held, at = [], key
                held += value[lo:hi]
        if len(held) > 1:
            yield out(held)

    tasks = max(partitions(values.sparkSession), math.ceil(n * len(choices) / 200_000))
    return keyed.repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (the smallest doc_id reachable by links).

    Reads doc_id and text. Documents of equal fingerprint are one node of the graph, so copies cost
    nothing beyond their row. Null and blank texts have fingerprint 0 and link like any other. Null
    ids are never a component's name; a component of null ids alone has a null one. Repeated rows
    get a row each; an empty table gives none.
    """
    prints = materialise(fingerprints(docs), "simhash")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    rooted = roots(links(nodes.select("fingerprint"), radius))
    named = nodes.join(rooted.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("fingerprint", "component_id")
    return prints.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
