"""What the removal of repeats and the Jaccard join write, and how long it stays."""

import os
import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import repeats
from plumbline.session import materialise, materialise_and_clear


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    dirs = [str(d) for d in blocks.localDirs()]
    return sum(f.startswith("shuffle_") and f.endswith(".data") for d in dirs for _, _, names in os.walk(d) for f in names)


def test_shuffle_files_go_once_the_table_is_written(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(key, None), shuffle_files(spark)
    rows = spark.range(2000).repartition(5, F.col("id") % 7).groupBy((F.col("id") % 90).alias("k")).count()
    made = materialise_and_clear(rows, "clear")
    assert shuffle_files(spark) <= files
    assert spark.conf.get(key, None) == before
    assert sorted(made.collect()) == sorted(materialise(rows, "kept").collect())


def shard_table(rows):
    return pa.table({"__shard": [0] * len(rows), "__id": pa.array([r[0] for r in rows], pa.int64()),
                     "__text": pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary())})


def test_copies_of_a_shard_send_nothing():
    rng = random.Random(3)
    text, other = words(rng, 60), words(rng, 60)
    rows = [(5, text), (2, text), (2, text), (9, text), (None, text), (3, other), (4, None), (6, "short"), (7, "short")]
    laid = repeats._rows(shard_table(rows), 50)
    assert [rows[i][0] for i, c in zip(laid.order, laid.copies) if c] == [5, 9]
    listed = repeats._list_anchors(50, 3)(shard_table(rows))
    assert not any(np.frombuffer(s, np.uint8).any() for s in listed["several"].to_pylist())


def test_strings_of_sixteen_bytes_in_common_are_no_repeat():
    """Texts grow into each other's short strings; those must not make units travel."""
    rng = random.Random(4)
    rows = [(i, words(rng, 12) + " the same sixteen " + words(rng, 12)) for i in range(30)]
    listed = repeats._list_anchors(50, 1)(shard_table(rows))
    assert not any(np.frombuffer(s, np.uint8).any() for s in listed["several"].to_pylist())


def test_crowds_of_copies_match_plain_version(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SHARD_BYTES", (3000, 3000))
    rng = random.Random(5)
    passages = [words(rng, 12) for _ in range(4)]
    crowd, few = words(rng, 40), words(rng, 30)
    rows = [(i, crowd) for i in rng.sample(range(-500, 500), 60)] + [(i, few) for i in (-3, 7, 7, 600)] + [(None, few), (None, crowd)]
    rows += [(700 + i, words(rng, 5) + rng.choice([*passages, few[:90], crowd[20:130]]) + words(rng, 5)) for i in range(80)]
    want = brute.repeats(rows)
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("sha", F.sha2("kept", 256)).collect()
    as_row = lambda i, v: (-10**9 if i is None else i, *v)
    assert sorted(as_row(r["doc_id"], (r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), r["sha"])) for r in found) == sorted(
        as_row(i, want[i, t]) for i, t in rows)


def test_sizes_and_first_bytes_do_not_make_up_for_each_other():
    """In " a a a ..." all words are alike, so only the first byte and the size tell strings apart."""
    strings = [bytes([b]) + b" a" * ((n - 1) // 2) + b" " * ((n - 1) % 2) for b in range(97, 123) for n in range(50, 70)]
    data, starts = repeats._lay([*strings, b"\0" * 8])
    found = repeats._hashes(data, starts[:len(strings)], np.diff(starts)[:len(strings)], 76)
    assert len(np.unique(found)) == len(strings)
