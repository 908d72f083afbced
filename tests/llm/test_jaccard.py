"""The Jaccard join against all pairs of sets of shingles."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import jaccard, queries

DOCS = "doc_id long, text string, node string, size string"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def plain_groups(rows):
    """(doc_id, n_shingles, component_id) per row, by comparing all pairs."""
    sets = [plain_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and min(len(x), len(y)) * 10 >= max(len(x), len(y)) * 9 and 100 * len(x & y) >= 90 * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def family(rng, size, n, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            del w[rng.randrange(len(w)):][:2]
        yield " ".join(w)


def odd_rows(seed=3):
    rng = random.Random(seed)
    shapes = [(150, 60, 6), (33, 25, 2), (25, 30, 1), (22, 20, 1), (12, 20, 1), (600, 10, 24), (60, 40, 3), (9, 6, 1)]
    texts = [t for shape in shapes for t in family(rng, *shape)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) + " " + passage for _ in range(40)]
    texts += [None, "", " \n", "Ab CD", "aB cd", "one", "ONE", "same  words here", "Same\twords here", "la " * 40, "la " * 9, "la la"]
    texts += ["a b c d e f g h i j k l m", "é ü 中文 \U0001f600 ñ x", "É ü 中文 \U0001f600 ñ x"]
    rows = list(enumerate(texts))
    rows += [(5, texts[5]), (5, texts[5]), (None, texts[0]), (None, "nobody else has these words"), (None, None)]
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)
    return sorted(map(tuple, jaccard.groups(df).collect()), key=str)


@pytest.mark.parametrize("small", [None, 0, 24, 40])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, small):
    if small is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda sizes: small)
    rows = odd_rows()
    assert run(spark, rows) == sorted(plain_groups(rows), key=str)


@pytest.mark.parametrize("near, crowd", [(1, 4), (2, 7)])
def test_crowded_lists_are_dealt_out_without_loss(spark, monkeypatch, near, crowd):
    monkeypatch.setattr(jaccard, "NEAR", near)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rows = odd_rows(8)
    assert run(spark, rows) == sorted(plain_groups(rows), key=str)


def test_nothing_and_blanks(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (3, "\t")]) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_very_long_text_is_read_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    long = " ".join(words)
    cut = " \n".join(words[:-9000])
    rows = [(1, long), (2, cut), (3, "x" * 3_000_000), (4, " " * 2_000_000), (5, "la " * 700_000)]
    want = sorted(plain_groups(rows), key=str)
    assert run(spark, rows) == want
    monkeypatch.setattr(jaccard, "_SLAB", 100)
    assert (jaccard.shingles(cut.encode()) == jaccard.shingles("  ".join(words[:-9000]).encode())).all()


def test_needed_overlap_is_exact():
    for n in range(1, 90):
        for m in range(jaccard.smallest(n), n + 1):
            o = jaccard.need(n, m)
            assert 100 * o >= 90 * (n + m - o) and 100 * (o - 1) < 90 * (n + m - o + 1)
            assert o in jaccard.subset_sizes(n) and o in jaccard.subset_sizes(m)
            assert (n - o) < jaccard.prefix(n) and (m - o) < jaccard.prefix(m)


def test_common_passage_among_strangers_makes_no_pairs(spark):
    """One line in thousands of unrelated texts: its shingles come last in every set's order."""
    rng = random.Random(6)
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(i, " ".join(f"v{rng.randrange(10**7)}" for _ in range(60)) + " " + line) for i in range(12_000)]
    found = run(spark, rows)
    assert [r[0] for r in found] == [r[2] for r in found] and len(found) == len(rows)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op12_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(plain_groups(rows))


def test_subset_links_join_every_pair_of_small_sets(spark):
    rows = [(i, t) for i, t in odd_rows(5) if t and 0 < len(plain_sets(t)) <= 40 and i is not None]
    sets = jaccard._sets(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS), jaccard.np.zeros(jaccard._SLOTS, int))
    nodes = sets.withColumn("node", F.col("doc_id"))
    links = jaccard._subset_links(nodes).collect()
    texts = dict(rows)
    for a, b in links:
        x, y = plain_sets(texts[a]), plain_sets(texts[b])
        assert 100 * len(x & y) >= 90 * len(x | y)


@pytest.mark.parametrize("crowd", [60, 4096])
def test_a_large_group_without_links_costs_rows_not_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = []
    for i in range(300):  # eight words of 600 differ: some 0.88 alike, by parity maps perhaps 0.9; every tenth has a copy with one more word
        w = list(base)
        for at in [0, 599, *(3 * x for x in rng.sample(range(1, 199), 6))]:
            w[at] = f"v{rng.randrange(10**6)}"
        texts += [" ".join(w)] + [" ".join([*w, "end"])] * (i % 10 == 0)
    counts, write = {}, jaccard.materialise

    def count(df, name):
        out = write(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", count)
    rows = list(enumerate(texts))
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_groups(rows))
    assert len({r["component_id"] for r in found}) >= 280
    assert max(counts.get(n, 0) for n in ("jaccard-pairs", "jaccard-links", "jaccard-joining")) <= 12 * len(texts), counts


def test_wide_maps_of_several_rows_differ_as_those_of_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (3, 200, 700, 900, 2500, 2700, 5000)]
    maps = [jaccard._parity(s, jaccard.map_bits(len(s))).tobytes() for s in sets]
    wide = jaccard._WideMaps(pa.chunked_array([pa.array(maps, pa.binary())]))
    for i, x in enumerate(maps):
        assert wide.differing(i, np.arange(len(maps))).tolist() == [jaccard._differing(x, y) for y in maps]


def test_large_sets_that_cannot_link_ask_for_no_whole_set():
    """The short maps of large sets allow any link; wide ones leave only rows that may have one."""
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    base = draw(2000)
    sets = [base, np.unique(np.concatenate([base[:1960], draw(30)]))]
    sets += [np.unique(np.concatenate([base[:400], draw(1600)])) for _ in range(6)]
    maps = np.array([jaccard._parity(s, 64 * jaccard._MAP).view("<i8") for s in sets])
    n = len(sets)
    rows = {"element": [1] * n, "lo": [0] * n, "hi": [0] * n, "block": [0] * n, "node": list(range(n)),
            "size": [len(s) for s in sets], "root": list(range(n)), **{m: maps[:, i] for i, m in enumerate(jaccard._MAPS)}}
    wide = pa.array([jaccard._parity(s, jaccard.map_bits(len(s))).tobytes() for s in sets], pa.binary())

    def left(table):
        return sorted(x for b in jaccard._undecided(iter(table.to_batches())) for x in b.column("node").to_pylist())

    assert left(pa.table(rows)) == list(range(n))
    assert left(pa.table({**rows, "wide": wide})) == [0, 1]
