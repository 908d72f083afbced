"""Quality posteriors, nearest neighbours, and the pipeline stage by stage."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import neighbours, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_catches_bad_documents_and_keeps_clean_ones(spark):
    judged = queries.op6_quality_bayes(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    bad = [r for r in judged if r["quality"] == 0 or r["toxic"] == 1]
    clean = [r for r in judged if r["quality"] == 1 and r["toxic"] == 0]
    # Only 399 labels here: toxic words of the rarer languages are seen in a handful of documents.
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.85
    assert sum(r["keep"] for r in clean) / len(clean) > 0.97


def test_quality_of_documents_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learned = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0
    model = quality.fit(docs, labels.where(learned))
    rows = quality.judge(docs, model, F.col("source"), F.col("lang")).join(labels.where(~learned), "doc_id").collect()
    bad = [r["keep"] for r in rows if r["quality"] == 0 or r["toxic"] == 1]
    clean = [r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(bad) / len(bad) < 0.08 and sum(clean) / len(clean) > 0.99


def test_site_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "p", 0.9)] * 200 + [("big", "q", 0.1)] * 200 + [("bad", "p", 0.05)] * 300 + [("one", "p", 0.0)] + [("two", "p", 1.0)] * 2
    found = {(r["site"], r["path"]): r for r in quality.site_posteriors(spark.createDataFrame(rows, "site string, path string, good double")).collect()}
    whole = sum(r[2] for r in rows) / len(rows)
    assert all(r["overall"] == pytest.approx(whole) for r in found.values())
    assert found["bad", "p"]["prior"] < 0.1
    assert 0 < found["one", "p"]["prior"] < whole < found["two", "p"]["prior"] < 1


def test_quality_of_odd_rows(spark):
    rows = [(i, "good words in a row number %d" % i, f"s{i % 3}", None, 1.0) for i in range(40)] + [
        (100 + i, "!!! %%% ### $$$ !!!", "s0", "p", 1.0) for i in range(20)] + [(None, None, None, None, None), (7, "", "s1", "", 0.0), (8, "long " * 50_000, None, "p", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, path string, posterior double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, None) for i in range(20)] + [(None, 0, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    judged = quality.judge(df, quality.fit(df, labels), F.col("source"), F.col("path")).collect()
    assert len(judged) == len(rows)
    assert all(not r["keep"] for r in judged if r["doc_id"] and 100 <= r["doc_id"]) and all(r["keep"] for r in judged if r["doc_id"] in range(9, 40))
    untaught = quality.fit(df, labels.where("false"))
    assert all(r["keep"] for r in quality.judge(df, untaught, F.col("source"), F.col("path")).collect())
    assert quality.judge(df.where("false"), untaught, F.col("source"), F.col("path")).collect() == []


def test_quality_with_and_without_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    args = docs, model, F.col("source"), F.col("lang")
    whole, narrow = quality.judge(*args), quality.judge(*args, keep_text=False)
    assert "text" in whole.columns and "text" not in narrow.columns
    assert sorted(whole.select("doc_id", "posterior").collect()) == sorted(narrow.select("doc_id", "posterior").collect())


def plain_nearest(rows, k):
    """rows: (id, vector); per query id divisible by 20 the k best."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, qv in good:
        if q % 20 == 0:
            out[q] = sorted(((-float((v * qv).sum()), i) for i, v in good if i != q))[:k]
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(30)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 7),
                                                           (404, [1.0, None] * 4), (405, [float("inf")] * 8), (None, [1.0] * 8), (406, [])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    found = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    want = plain_nearest(rows, 20)
    assert set(found) == set(want)
    for q, best in want.items():
        assert [(i, v) for _, s, v in sorted(found[q]) for i in [round(s, 9)]] == [(round(s, 9), v) for s, v in best]
    assert neighbours.nearest(df.where("false"), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect() == []
    few = neighbours.nearest(df.where("vec_id < 5"), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4


def test_neighbours_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_LIST", 50)
    monkeypatch.setattr(neighbours, "_SHARD_ROWS", 40)
    monkeypatch.setattr(neighbours, "_SHARD_QUERIES", 7)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = {}
    for r in queries.op8_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = 0
    for q, got in found.items():
        assert sorted(rank for rank, _ in got.values()) == list(range(1, 21)) and q not in got
        scores = (x * x[ids == q][0]).sum(axis=1)
        assert all(s == pytest.approx(scores[ids == v][0], abs=1e-12) for v, (_, s) in got.items())
        scores[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(got))
    assert len(found) == (ids % 20 == 0).sum() and hits / (20 * len(found)) >= 0.9


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    norm = np.sqrt((x ** 2).sum(1))
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    turned = x @ rotation.T
    align = np.abs(turned).sum(1) / norm / 8
    guess, bound = neighbours.estimate(np.packbits(turned > 0, axis=1), norm, align, rotation @ q, 0.0)
    assert (np.abs(guess - x @ q) <= bound).mean() > 0.99


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
        out[-1].count()
    yield out
    for df in out:
        df.unpersist()


def test_stages_return_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "source mix", "packing"]
    assert all(df.dtypes == stages[0].dtypes for df in stages[1:-1])


def test_near_copies_leave_one(stages):
    from test_copies import plain_roots

    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({rows[r][0] for r in plain_roots([t for _, t in rows])})


def test_passages_go_once(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = brute.repeats(rows)
    left = {r["doc_id"]: r for r in stages[3].collect()}
    for (i, t), (size, removed, runs, _) in want.items():
        kept = left[i]["text"].encode()
        assert size - removed <= len(kept) <= size - removed + 6 * runs and left[i]["n_chars"] == len(left[i]["text"])
        assert removed or left[i]["text"] == (t or "")


def test_mix_takes_the_planned_words(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()]
    want = {i: taken for i, _, _, _, taken in brute.mix(rows)}
    got = dict.fromkeys(want, 0)
    for r in stages[4].collect():
        got[r["doc_id"]] += len(brute.words(r["text"]))
    assert got == want


def test_sequences_hold_the_mixed_documents(stages):
    from test_tokens import check_pieces

    from plumbline.llm import tokens

    docs = [(r["doc_id"], [*tokens.encode(tokens.vocabulary_path(), r["text"], added=True).tolist(), 1]) for r in stages[4].collect()]
    check_pieces(stages[5].withColumn("crc", F.crc32("ids")).collect(), docs)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0] == stages[5].agg(F.sum("length")).first()[0]


def test_hot_links_stay_whole(spark):
    """A crowd of near fingerprints and many copies: one row per document, one group."""
    from plumbline.llm import components

    rng = random.Random(2)
    nodes = list(range(400))
    pairs = [(n, rng.randrange(n)) for n in nodes[1:]]
    found = dict(components.roots(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {n: 0 for n in nodes[1:]}
    assert components.roots(spark.createDataFrame([], "a long, b long")).collect() == []
