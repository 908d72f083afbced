"""Vector codes against plain k-means in whole numbers; trees against their points."""

import hashlib
import math
import random

import numpy as np
import pytest

from plumbline.llm import queries, vector_codes

ROWS = "vec_id long, embedding array<float>, label int, code string, error string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, label, code, error, label_error)} and the digest of the codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for _, v, _ in kept:
                owned.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, points in owned.items():
                books[p][e] = [sum(c) // len(points) for c in zip(*points)]
    out, sums = [], {}
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        sums[label] = sums.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(*r, sums[r[1]]) for r in out], digest


def odd_vectors(n=150, d=24, seed=4):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)])) for _ in range(d)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]  # one vector many times
    rows += [(3, rows[3][1], 0), (3, rows[3][1], 0), (None, rows[9][1], 2), (-5, rows[11][1], None)]
    rows += [(2000, None, 1), (2001, [None] * d, 1), (2002, [float("nan")] * d, 1), (2003, [float("inf")] + [0.0] * (d - 1), 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, leaf", [(8192, 24), (40, 2)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vector_codes, "_BLOCK", block)
    monkeypatch.setattr(vector_codes, "_LEAF", leaf)
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "c", "e") for r in rows], ROWS).repartition(3)
    got = vector_codes.encode(df).collect()
    want, digest = plain_codes(rows)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert {r["codebooks_sha256"] for r in got} == {digest}


@pytest.mark.parametrize("rows", [
    [], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(1, [0.5], 1)], [(1, [0.5, 1.0], 1), (2, [0.25] * 9, 1), (3, [], 2)],
    [(i, [1.0] * 8, 1) for i in range(20)]])
def test_few_short_and_ragged_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "c", "e") for r in rows], ROWS)
    got = vector_codes.encode(df).collect()
    want, digest = plain_codes(rows)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert not got or got[0]["codebooks_sha256"] == digest


def test_components_too_large_to_be_exact_are_refused():
    with pytest.raises(ValueError, match="cannot be coded exactly"):
        vector_codes.steps(np.array([1e6]))


@pytest.mark.parametrize("seed", range(6))
def test_trees_cover_their_points_and_settle_them_exactly(seed):
    rng = np.random.default_rng(seed)
    points = np.unique(np.floor(rng.normal(0, 60, (rng.integers(1, 900), 3)) * rng.choice([1, 20])).astype(np.int64), axis=0)
    weights = rng.integers(1, 9, len(points))
    tree, place = vector_codes.grow(points, weights)
    assert (tree.points[place] == points).all() and (tree.weights[place] == weights).all()
    owned = 0
    for i, node in enumerate(tree.nodes):
        mine, w = tree.points[node["lo"]:node["hi"]], tree.weights[node["lo"]:node["hi"]]
        assert node["count"] == w.sum() and (tree.sums[i] == (mine * w[:, None]).sum(axis=0)).all()
        assert np.sqrt(((mine - tree.centres[i]) ** 2).sum(axis=1)).max() <= node["radius"]
    entries = points[rng.integers(0, len(points), 9)] + rng.integers(-2, 3, (9, 3))
    code = np.full(len(points), -1)
    for node, loose, entry in vector_codes.settle(tree, entries):
        if loose is not None:
            assert (code[loose] == -1).all()
            code[loose] = entry
            continue
        for k, e in zip(node, entry):
            lo, hi = tree.nodes["lo"][k], tree.nodes["hi"][k]
            assert (code[lo:hi] == -1).all()
            code[lo:hi] = e
            owned += hi - lo
    assert (code == vector_codes.squared(tree.points, entries).argmin(axis=1)).all()
    assert owned or len(points) < 400


def test_query_equals_plain_rounds(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = plain_codes(rows)
    got = queries.op13_vector_codes(spark, sf_dir).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted((i, c, e, s) for i, _, c, e, s in want)
    assert {r["codebooks_sha256"] for r in got} == {digest}
