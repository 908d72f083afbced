"""Token ids, separator scan and packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import packing, queries, tokens

ODD = ["", " ", "a", "  two  spaces \n\n and\tmore ", "it's we're I'll 's", "<|endoftext|> is text", "é中文 \U0001f600́", "1234 5.6 %%%",
       "x" * 3000, "\r\n 　wide", "\x00\x01", "ÄÖ ß ẞ ĳ ǅ ₂ ½ ٣"]


LONG = [" " * 1_000_000, "\n" * 300_000 + "a", "a" + " \t\u3000" * 50_000 + " it's", "a\x1c" + "\u00a0" * 150_000 + "b" + " " * 150_000,
        "x" * 1_500_000, "end" + " " * 100_000, " " * 99_999 + "<|endoftext|>" + " " * 100_001 + "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokens.vocabulary_path())
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_default():
    """The tokenizers library as it is after loading: added tokens have their own ids."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD + LONG, ids=lambda t: f"{t[:8]!r}-{len(t)}")
def test_ids_of_odd_texts(reference, by_default, text):
    assert tokens.encode(tokens.vocabulary_path(), text).tolist() == reference(text)
    assert tokens.encode(tokens.vocabulary_path(), text, added=True).tolist() == by_default(text)


def test_added_tokens_have_their_own_ids(by_default):
    text = "a <|endoftext|> b<|endoftext|><|endoftext|>"
    assert tokens.encode(tokens.vocabulary_path(), "a <|endoftext|> b", added=True).tolist() == [64, 220, 50256, 275]
    assert tokens.encode(tokens.vocabulary_path(), text, added=True).tolist() == by_default(text)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    global _known
    try:
        known = _known
    except NameError:
        known = _known = Tokenizer.from_file(tokens.vocabulary_path())
        known.encode_special_tokens = True
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encode(tokens.vocabulary_path(), text).tolist() == known.encode(text, add_special_tokens=False).ids


def odd_rows():
    rng = random.Random(5)
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)] + [(100, None, 1, 2), (None, "null id", None, None), (7, "twice", 0, 0), (7, "twice", 0, 0)]
    return rows + [(200 + i, " ".join(rng.choices(["lorem", "ipsum", "dolor"], k=rng.randrange(1, 3000))), 0, 0) for i in range(20)]


SCHEMA = "doc_id long, text string, length int, block int"


@pytest.mark.parametrize("block_ids", [1, 7, 1000, 1 << 18])
def test_counts_do_not_depend_on_blocks(spark, reference, monkeypatch, block_ids):
    monkeypatch.setattr(tokens, "_BLOCKS_PER_CHUNK", 3)
    rows = odd_rows()[: 16 if block_ids == 1 else None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = tokens.write_blocks(df, block_ids=block_ids).cache()
    got = sorted((-1 if r[0] is None else r[0], r[1]) for r in tokens.named_counts(blocks).collect())
    assert got == sorted((-1 if r[0] is None else r[0], len(reference(r[1]))) for r in rows)
    blocks.unpersist()


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = []
    for name in ("one", "two", "none", "open"):
        ids = rng.integers(0, 9, 500).astype("<u2") if name != "none" else np.full(40, 3, "<u2")
        if name != "open":
            ids[-1] = 5
        if name == "none":
            ids[:] = 3
        (tmp_path / name).write_bytes(ids.tobytes())
        at = 0
        for n, end in enumerate([*np.flatnonzero(ids == 5), len(ids)]):
            if end > at or end < len(ids):
                want.append((name, n, at, int(end - at), bool(end < len(ids))))
            at = int(end) + 1
    (tmp_path / "empty").write_bytes(b"")
    blocks = tokens.read_flat_files(spark, str(tmp_path), block_ids=33)
    got = [(r["stream"].rsplit("/", 1)[1], *r[1:]) for r in tokens.document_counts(blocks, separator=5).collect()]
    assert sorted(got) == sorted(want)


def test_counts_of_all_documents(spark, sf_dir, reference):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = dict(queries.op1_token_counts(spark, sf_dir).collect())
    assert got == {i: len(reference(t)) for i, t in docs.items()}


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.named_counts(tokens.write_blocks(empty)).collect() == []
    assert packing.pack(empty).collect() == []


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_windows_hold_every_id_once(sizes):
    windows = packing.plan_windows(sizes, 512)
    assert all(0 < sum(n for _, _, n in w) <= 512 for w in windows)
    pieces = sorted((i, s, n) for w in windows for i, s, n in w)
    for item, size in enumerate(sizes):
        at = 0
        for _, start, n in (p for p in pieces if p[0] == item):
            assert start == at and n > 0
            at += n
        assert at == size
    assert len(windows) <= sum(n // 512 for n in sizes) + -(-sum(n % 512 for n in sizes) // 512)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_differencing_deals_all_items(sizes, windows):
    groups = packing.differencing(sizes, windows)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) <= windows
    sums = [sum(sizes[i] for i in g) for g in groups] + [0] * (windows - len(groups))
    assert max(sums) - min(sums) <= max(sizes)


def test_packed_pieces(spark, by_default):
    rows = odd_rows()
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(2)).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(pieces, [(r[0], [*by_default(r[1]), 1]) for r in rows])


def check_pieces(pieces, docs):
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(bytes(p["ids"])) == p["crc"]
    for s in by_sequence.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:i]) for i in range(len(s))]
        assert sum(p["length"] for p in s) == s[0]["sequence_length"] <= packing.CAPACITY
    whole = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        whole.setdefault(p["doc_id"], []).append((p["start"], list(np.frombuffer(bytes(p["ids"]), "<u4"))))
    want = {}
    for doc_id, ids in docs:
        want.setdefault(doc_id, []).extend(ids)
    assert {d: sorted(i for _, x in ps for i in x) for d, ps in whole.items()} == {d: sorted(i) for d, i in want.items()}
    single = {d for d in want if sum(x == d for x, _ in docs) == 1}
    assert all([i for _, x in whole[d] for i in x] == want[d] for d in single)
