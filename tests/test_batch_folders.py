"""A folder of part files is one table in a batch, unless the manifest names a file."""

import json

import pytest

from plumbline.plans import batch
from plumbline.plans.batch import Entry, batch_audit, read_manifest


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_folder_is_read_whole(spark, tmp_path, fmt):
    folder = str(tmp_path / "parts")
    spark.range(100).selectExpr("id", "id % 2 AS y").repartition(4).write.option("header", True).format(fmt).save(folder)
    assert batch._load(spark, Entry(folder, "y")).count() == 100
    assert batch._load(spark, Entry(folder, "y", 1)).count() < 100
    named, whole = read_manifest(json.dumps({folder: {"target_column": "y", "no_dataset": 1}, folder + "/": {"target_column": "y"}}))[0]
    assert batch._load(spark, named).count() < 100 and batch._load(spark, whole).count() == 100


def test_batch_audits_all_rows_of_a_folder(spark, tmp_path):
    folder = str(tmp_path / "parts")
    spark.range(400).selectExpr("id", "id % 7 AS a", "id % 2 AS y").repartition(4).write.parquet(folder)
    report, _ = batch_audit(spark, [Entry(folder, "y", row_id="id", timeout=60)])
    overview = {r["item"]: r["value"] for r in report.where("section = 'overview'").collect()}
    assert "400" in {v.split(".")[0] for v in overview.values() if v}
