"""Importance resampling against plain counting and sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import resampling

DOCS = "doc_id long, text string, score string, rank string"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, percent=10, longest=1, buckets=10_000, least=20, seed=2024):
    own, aim = [0] * buckets, [0] * buckets
    for counts, texts in ((own, [t for _, t in rows]), (aim, target)):
        for t in texts:
            for h in plain_features(t, longest)[1]:
                counts[h % buckets] += 1
    s, t = sum(own) + buckets, sum(aim) + buckets
    gain = [math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(own, aim)]
    out = []
    for i, text in rows:
        words, runs = plain_features(text, longest)
        weight = sum(gain[h % buckets] for h in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((words >= least, -score, i is None, i or 0, len(runs), weight, i, score))
    able = sorted(r for r in out if r[0]) if all(r[6] is not None for r in out) else sorted((r for r in out if r[0]), key=lambda r: r[:6])
    rank = {}
    for place, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r[:6], []).append(place + 1)
    result = []
    for r in out:
        places = rank.get(r[:6])
        result.append((r[6], r[4], r[5], r[7], places.pop() if places else None))
    return sorted(result, key=str)


def odd_rows(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma-7", "zéta", "中文", "x" * 40, "42", "it's", "\U0001f600"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 60])))) for i in range(n)]
    rows += [(5, rows[5][1])] * 3 + [(7, rows[11][1]), (None, rows[12][1]), (None, "alpha " * 30), (None, None)]
    rows += [(10_000 + i, "same words " * 15) for i in range(60)]
    rows += [(20_000, None), (20_001, ""), (20_002, " .,\n"), (20_003, "beta " * 50_000)]
    rows += [(30_000, "repeated row " * 12)] * 50
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("longest, percent, pivots", [(1, 10, 32), (3, 37, 2), (1, 100, 5)])
def test_draw_is_that_of_a_plain_sort(spark, monkeypatch, longest, percent, pivots):
    monkeypatch.setattr(resampling, "_PIVOTS", pivots)
    rows, target = odd_rows(), ["alpha beta beta", None, "", "gamma 7 zéta"] * 5
    df = spark.createDataFrame([(*r, "s", "r") for r in rows], DOCS).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, resampling.resample(df, aim, percent, longest).collect()), key=str)
    assert got == plain_resample(rows, target, percent, longest)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i % 97}-é" for i in range(3000)).encode() + b" " + b"y" * 500
    whole = [b for _, found in resampling.features(text, 3) for b in found.tolist()]
    monkeypatch.setattr(resampling, "_SLAB", 64)
    pieces = [b for _, found in resampling.features(text, 3) for b in found.tolist()]
    assert sorted(whole) == sorted(pieces) == sorted(h % 10_000 for h in plain_features(text.decode(), 3)[1])


def test_nothing_to_draw(spark):
    empty = spark.createDataFrame([], DOCS)
    assert resampling.resample(empty, empty).collect() == []
    short = spark.createDataFrame([(1, "a few words", "s", "r"), (2, None, "s", "r")], DOCS)
    got = resampling.resample(short, empty).collect()
    assert [r["rank"] for r in got] == [None, None] and [r["n_features"] for r in sorted(got)] == [3, 0]


def test_kth_key_of_rows_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice(["a", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x long, y string, row long")
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for k in (1, 2, 250, 499, 500):
        key = resampling.kth_key(df, ["x", "y", "row"], k)
        assert tuple(df.select(key.alias("k")).first()["k"]) == order[k - 1]
        assert df.where(F.struct("x", "y", "row") <= key).count() == k
