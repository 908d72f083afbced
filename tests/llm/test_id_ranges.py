"""Ranges of ids hold about equally many rows, whatever the ids."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints


@pytest.mark.parametrize("ids", [[*range(2000), 1 << 40], [c * 10**12 + i for c in range(4) for i in range(500)], [3], []])
def test_no_range_is_crowded(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "_ROWS_PER_BLOCK", 50)
    df = spark.createDataFrame([(i, f"text {i}") for i in [*ids, None]], "doc_id long, text string")
    got = df.select(fingerprints._id_range(df).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in got) <= 150
    found = fingerprints.next_document(df, ["doc_id"]).collect()
    order = [*sorted(ids), None]
    assert {r["doc_id"]: r["next_doc_id"] for r in found} == dict(zip(order, [*order[1:], order[0]])) and len(found) == len(order)
