"""The near-dedup stage against exact Jaccard similarities of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import copies


def plain_roots(texts):
    sets = [copies.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) * 5 >= len(x | y) * 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def family(rng, size, n, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        yield " ".join(w)


def odd_rows():
    rng = random.Random(3)
    texts = [t for size, n, edits in [(150, 60, 8), (30, 20, 2), (12, 10, 1), (600, 10, 20), (7, 6, 1)] for t in family(rng, size, n, edits)]
    texts += [None, "", " \n", "Ab CD", "aB cd", "one", "same  words", "Same words", "la " * 40, "la " * 90]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("near", [1, 8])
def test_stage_keeps_one_of_every_group(spark, monkeypatch, near):
    monkeypatch.setattr(copies, "_NEAR", near)
    rows = sorted(odd_rows())
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_roots([t for _, t, _ in rows])))
    assert copies.keep_one(df.where("false")).collect() == []


def test_documents_leave_no_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[r][0] for r in plain_roots([t for _, t in rows])}
    assert {r["doc_id"] for r in copies.keep_one(docs).collect()} == want


def test_rows_of_one_id_are_told_apart(spark):
    rng = random.Random(5)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (3, b, "y"), (1, a, "a"), (4, b + " end", "z"), (None, a, "n"), (None, a, "n")]
    kept = copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in kept) == sorted([(1, a, "a"), (1, b, "x"), (0, a, "n"), (0, a, "n")])


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_blocks_meet_at_the_least_similarity(n):
    bits, count = copies.blocks(n)
    assert n / 2**bits <= 4 and (1 - (1 - copies.apart()) ** bits) ** count <= 0.01


def test_tree_finds_all_within_a_radius(monkeypatch):
    monkeypatch.setattr(copies, "_LEAF", 4)
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    bits[100:200] = bits[0] ^ (np.uint64(1) << rng.integers(0, 60, (100, 4), dtype=np.uint64))
    bits[200:240] = bits[7]
    tree = copies.Tree(bits)
    assert sorted(tree.order) == list(range(300)) and len(tree.children) > 5
    for i in (0, 7, 120, 299):
        for radius in (0, 3, 8, 61.7, 125):
            d = np.bitwise_count(bits ^ bits[i]).sum(axis=1)
            assert sorted(tree.within(bits[i], radius)) == np.flatnonzero(d <= radius).tolist()


def counted(monkeypatch, module):
    """Rows of every table the module writes from here on."""
    rows, write = {}, module.materialise

    def count(df, name):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(module, "materialise", count)
    return rows


@pytest.mark.parametrize("crowd", [40, 2048])
def test_a_large_group_without_links_costs_rows_not_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(copies, "CROWD", crowd)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(400):  # four words of 200 differ: some 0.66 alike; every tenth has one like it, with four more words
        w = list(base)
        for at in rng.sample(range(1, 39), 4):
            w[5 * at] = f"v{rng.randrange(10**6)}"
        texts += [" ".join(w)] + [" ".join([*w, "and", "so", "it", "ends"])] * (i % 10 == 0)
    rows = counted(monkeypatch, copies)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in copies.keep_one(df).collect()}
    assert kept == set(plain_roots(texts)) and len(kept) >= 395
    assert rows["copies-pairs"] <= 80 * len(texts) and rows["copies-links"] <= 2 * len(texts), rows


@pytest.mark.parametrize("batch", [7, 64, 400])
def test_a_crowded_block_gives_its_rows_once(batch):
    rng = np.random.default_rng(8)
    sight = np.repeat(rng.integers(0, 1 << 62, (1, copies._SIGHT)), 300, axis=0) ^ (1 << rng.integers(0, 60, (300, copies._SIGHT)))
    columns = [np.zeros(300, np.int32), np.zeros(300, np.int64), np.arange(300), np.full(300, 50, np.int32), *sight.T]
    rows = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=copies._MEETING)
    found = pa.Table.from_batches(copies._neighbours(rows.slice(at, batch) for at in range(0, 300, batch))).to_pylist()
    assert len(found) <= 300 + (copies._NEAR * (copies._NEAR + 1) / 2 if batch <= copies._NEAR else 0)
    assert sorted(r["node"] for r in found if r["shard"] is not None) == list(range(300))
    # Pairs connect the whole block, and a row that carries one is its second node.
    assert {r["b"] for r in found if r["a"] is not None} == set(range(1, 300))
    assert all(r["node"] in (None, r["b"]) for r in found if r["a"] is not None)
