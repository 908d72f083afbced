"""Repeated passages and near-duplicate groups against plain Python."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import queries, repeats, simhash


def plain_owners(strings, owner, length):
    least = {}
    for s, o in zip(strings, owner):
        for i in range(len(s) - length + 1):
            least[s[i:i + length]] = min(o, least.get(s[i:i + length], o))
    return [least[s[i:i + length]] for s in strings for i in range(len(s) - length + 1)]


@given(st.lists(st.text("ab\x00z", min_size=5, max_size=40), min_size=1, max_size=25), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_merged_transforms_find_all_intervals(texts, shards, seed):
    strings = [t.encode() for t in texts]
    rng = np.random.default_rng(seed)
    owner = rng.integers(0, 50, len(strings))
    group = np.sort(rng.integers(0, shards, len(strings)))
    assert repeats._interval_owners(strings, owner, group, 5).tolist() == plain_owners(strings, owner.tolist(), 5)


def test_merge_matches_one_sort():
    rng = random.Random(4)
    strings = ["".join(rng.choices("abc", k=rng.randrange(3, 30))).encode() for _ in range(40)]
    parts = [strings[:13], strings[13:14], strings[14:]]
    transforms = [repeats.shard_transform(p)[1] for p in parts]
    shard, block = repeats.merge_transforms(transforms, [len(p) for p in parts], 40)
    merged = np.empty(len(shard), np.uint8)
    merged[np.argsort(shard, kind="stable")] = np.concatenate(transforms)
    assert merged.tolist() == repeats.shard_transform(strings)[1].tolist()
    assert block.tolist() == list(range(len(block)))


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_units_cover_every_window_once(texts):
    data, starts = repeats._lay(texts)
    units = repeats._units(data, starts, 50)
    got = sorted((int(r), int(f) + i) for f, n, r in zip(units.first, units.count, units.row) for i in range(n))
    assert got == [(r, int(starts[r]) + i) for r, t in enumerate(texts) for i in range(len(t) - 49)]


def odd_texts(seed=8):
    """Small alphabets, shared passages at changing borders, runs, multi-byte letters."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.randrange(40, 200))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a:a + rng.randrange(20, 200)], "".join(rng.choices("abcdé ", k=rng.randrange(0, 30)))]
        rows.append((rng.randrange(10**6) - 5 * 10**5, "".join(parts)))
    rows += [(7, None), (8, ""), (9, "short"), (None, passages[0]), (None, None), (10, "ab" * 400), (11, "ab" * 300), (12, "x" * 700),
             (13, "x" * 49), (14, "x" * 50), (15, passages[1]), (15, passages[1]), (15, passages[1] + "!"), (16, "\x00" * 120), (17, "\x00" * 60)]
    return rows


@pytest.mark.parametrize("shard_bytes, hot_shards", [(1 << 20, 256), (2000, 256), (2000, 1), (1 << 20, 0)])
def test_repeats_match_plain_version(spark, monkeypatch, shard_bytes, hot_shards):
    monkeypatch.setattr(repeats, "_HOT_SHARDS", hot_shards)
    monkeypatch.setattr(repeats, "_SHARD_BYTES", (shard_bytes, shard_bytes))
    monkeypatch.setattr(repeats, "_SORT_BYTES", 3000)
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "x", 5, 1) for i, t in rows], "doc_id long, text string, shard string, owners int, spans int")
    want = brute.repeats(rows)
    found = repeats.remove_repeats(df).withColumn("sha", F.sha2("kept", 256)).collect()
    assert len(found) == len(rows)
    as_row = lambda i, v: (-10**9 if i is None else i, *v)
    assert sorted(as_row(r["doc_id"], (r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), r["sha"])) for r in found) == sorted(
        as_row(i, want[i, t]) for i, t in rows)


def test_kept_text_is_whole_characters(spark):
    rows = odd_texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in repeats.remove_repeats(df, whole_characters=True).collect():
        bytes(r["kept"]).decode()
    assert repeats.remove_repeats(df.where("false")).collect() == []


def test_repeats_of_the_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: v for (i, _), v in brute.repeats(rows).items()}
    assert {r[0]: tuple(r[1:]) for r in queries.op4_remove_repeats(spark, sf_dir).collect()} == want


def crowd(rng, n, spread):
    centre = rng.getrandbits(64)
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread))) for _ in range(n)]


@pytest.mark.parametrize("spread", [3, 6, 12])
def test_tree_links_join_the_right_groups(spread):
    rng = random.Random(spread)
    values = list(dict.fromkeys(v for _ in range(6) for v in crowd(rng, 60, spread)))
    want = brute.components(values)
    place = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    links = list(simhash._forest(values, 4))
    assert len(links) <= len(values)
    for a, b in links:
        parent[find(place[a])] = find(place[b])
    got = [find(i) for i in range(len(values))]
    assert {frozenset(i for i in range(len(values)) if got[i] == r) for r in got} == {
        frozenset(i for i in range(len(values)) if want[i] == r) for r in want}


@pytest.mark.parametrize("n, m", [(10, 1), (10**8, 2), (10**11, 3)])
def test_blocks_find_all_links(spark, monkeypatch, n, m):
    choices = simhash.agreeing_blocks(n)
    assert {len(c) for c in choices} == {m}
    rng = random.Random(m)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & sum((1 << hi) - (1 << lo) for lo, hi in c) == 0 for c in choices)


def test_groups_match_plain_version(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choices(["ka", "lo", "mi", "nu", "pe", "ra"], k=80)) for _ in range(12)]
    rows = [(None, "null id"), (500, None), (501, ""), (502, " \n"), (503, "Ab CD"), (504, "aB cd"), (505, "É x y z"), (506, "é x y z"), (499, "same id"), (499, "same id")]
    for i in range(80):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["new", "other"])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, fingerprint string, root int")
    found = simhash.near_groups(df).collect()
    prints = [brute.simhash(t) for _, t in rows]
    root = brute.components(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((-1 if i is None else i, p, least.get(r, -1)) for (i, _), p, r in zip(rows, prints, root))
    assert sorted((-1 if r[0] is None else r[0], r[1] & (1 << 64) - 1, -1 if r[2] is None else r[2]) for r in found) == want
    assert simhash.near_groups(df.where("false")).collect() == []


def test_groups_of_the_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute.simhash(t) for _, t in rows]
    want = {rows[i][0]: (f"{p:016x}", rows[r][0]) for i, (p, r) in enumerate(zip(prints, brute.components(prints)))}
    assert {r[0]: (r[1], r[2]) for r in queries.op5_simhash_groups(spark, sf_dir).collect()} == want
