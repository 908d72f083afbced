"""Mixing, fingerprints, chat and language against plain Python, with odd rows."""

import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat, fingerprints, language, mixing, queries

DOCS = "doc_id long, text string, source string, size string, target int"


def some_docs(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zéta", "eta"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40]))), rng.choice(["a", "b", "B", None, "c"]), "x", 1)
            for i in range(n)]
    rows[4] = (4, None, "a", None, None)
    rows[5] = (5, " \t\n", "only blanks", None, None)
    return rows


def test_mix_matches_plain_version(spark):
    rows = some_docs()
    found = mixing.mix(spark.createDataFrame(rows, DOCS)).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = {r[0]: r for r in brute.mix([(r[0], r[1], r[2]) for r in rows])}
    assert len(found) == len(rows)
    for r in found:
        assert r["target"] == pytest.approx(want[r["doc_id"]][3])
        assert (r["size"], r["source_size"], r["taken"]) == (want[r["doc_id"]][1], want[r["doc_id"]][2], want[r["doc_id"]][4])


def test_mix_blocks_do_not_change_the_plan(spark, monkeypatch):
    df = spark.createDataFrame(some_docs(), DOCS)
    whole = sorted(map(tuple, mixing.mix(df).select("doc_id", "before", "taken").collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 3)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "before", "taken").collect())) == whole


def test_mixed_documents_hold_the_taken_words(spark):
    rows = some_docs() + [(None, "null id", "a", None, None), (7, "again", "b", None, None), (7, "again", "b", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(brute.words(r["text"]))
    for r in plan:
        assert abs(r["n"] - r["t"]) < 1
        assert abs(got.get(r["source"], 0) - r["n"]) <= 2


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == [] and mixing.mix_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", "a", None, None)], DOCS)
    assert [(r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2


def test_signature_matches_plain_version(spark):
    rng = random.Random(1)
    texts = [None, "", "   ", "a", "two words", "same " * 300, "x" * 50, "é中文 \U0001f600 b c"]
    texts += [" ".join(rng.choices(["ab", "cd", "longer-word", "z"], k=rng.randrange(1, 400))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, signature string").drop("signature")
    for r in fingerprints.fingerprints(df).collect():
        assert sorted(r["signature"]) == sorted(brute.order_minhash(r["text"])), r["text"]


def test_next_document_and_edit(spark, monkeypatch):
    rows = [(i * i * 37, f"text number {i} " * (i % 5 + 1)) for i in range(40)] + [(None, "no id"), (10**12, None), (5, "tie"), (5, "tie")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints.edit_report(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = [t or "" for _, t in order]
    edited = [t[:len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][:len(t) // 4] for i, t in enumerate(texts)]
    import hashlib
    want = sorted((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, _), t, e in zip(order, texts, edited))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert [r["near_next"] for r in found if r["doc_id"] == 5].count(1.0) >= 1
    one = fingerprints.edit_report(spark.createDataFrame([(3, "one two three four five six")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.edit_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprints_run_no_python(spark, sf_dir):
    plan = queries.op10_order_minhash(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_chat_rotation_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "_TURNS_PER_BLOCK", 2)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"), (1, 2, "user", "bye"), (1, None, None, None),
            (2, 5, " ", "alone"), (None, 1, "user", "no id"), (None, 0, "bot", "first"), (3, 0, "", "")]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "conv_id long, turn long, role string, text string, size int, segment string")
    segments = chat.rotate(df)
    texts = {(r["conv_id"], r["speaker"]): r for r in chat.render(segments).collect()}
    assert set(texts) == {(1, "user"), (1, "assistant"), (1, "unknown"), (2, "unknown"), (None, "user"), (None, "bot"), (3, "unknown")}
    text = texts[1, "assistant"]
    assert text["text"] == ("<|user|>unknown: <|end|>\n<|user|>user: hi<|end|>\n<|assistant|>\nhello<|end|>\n"
                            "<|user|>user: bye<|end|>\n<|user|>user: bye<|end|>\n")
    assert [text["text"][m["start"]:m["start"] + m["length"]] for m in text["masks"]] == ["hello<|end|>\n"]
    parts = sorted(chat.render(segments, 20).where("conv_id = 1 and speaker = 'user'").collect(), key=lambda r: r["part"])
    assert "".join(p["text"] for p in parts) == texts[1, "user"]["text"]
    assert chat.rotate(df.where("false")).collect() == []


@given(st.integers(2, 40))
@settings(max_examples=15, deadline=None)
def test_codewords_are_apart(n):
    words = language.codewords(n)
    assert len({tuple(w) for w in words}) == n and words.shape[0] == n
    assert all(0 < bit.sum() < n for bit in words.T)


def test_language_of_held_out_documents(spark):
    found = queries.op7_language_codes(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 5)]
    rows += [(20, None, "en"), (21, "", None), (22, "123 !!", "de"), (None, "the cat", None), (24, "die katze " * 5000, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(df, F.lit(True))
    found = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [found[i]["lang_pred"] for i in (20, 21, 22)] == ["und"] * 3
    assert found[None]["lang_pred"] == "en" and found[24]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = language.fit(df.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}
    one = language.fit(df.where("lang = 'de'"), F.lit(True))
    assert language.identify(df, one).where("doc_id = 0").first()["lang_pred"] == "de"
    assert language.identify(df.where("false"), model).collect() == []
