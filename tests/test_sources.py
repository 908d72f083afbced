import pytest

from plumbline.config import AuditConfig
from plumbline.plans import batch
from plumbline.plans.batch import Entry, audit_dataset, batch_audit, read_manifest, roll_up, run_with_limit
from plumbline.sources import readers, sinks
from workloads import source_queries
from workloads.fixtures import orders_wide


@pytest.mark.parametrize(("name", "body", "encoding"), [
    ("a.csv", "id,name\n1,x\n2,y\n", "utf-8"), ("b.csv", "id;name\n1;x,1\n2;y,2\n", "utf-8"),
    ("c.tsv", "id\tname\n1\tx\n2\ty\n", "utf-8"), ("d.csv", "id|name\n1|x\n2|y\n", "utf-8"),
    ("e.csv", "id;name\n1;é\n2;ü\n", "latin-1"), ("f.csv", "id,name\n1,é\n2,ü\n", "utf-8"),
])
def test_delimiter_and_encoding(spark, tmp_path, name, body, encoding):
    (tmp_path / name).write_bytes(body.encode(encoding))
    df = readers.load_table(spark, str(tmp_path / name))
    assert df.columns == ["id", "name"] and [r.id for r in df.orderBy("id").collect()] == [1, 2]
    assert df.orderBy("id").first().name == body.split("\n")[1][2:]


def test_fallback_delimiter():
    assert readers.guess_delimiter("a") == "," and readers.guess_delimiter("x;y\n") == ";"
    assert readers.guess_encoding("caf\u00e9".encode()[:-1]) == "UTF-8"  # cut inside a character
    assert readers.guess_encoding("caf\u00e9 x".encode("latin-1")) == "ISO-8859-1"


def test_content_beyond_the_sample(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes("id,name\n".encode() + b"".join(f"{i},plain\n".encode() for i in range(2000)) + "2000,caf\u00e9\n".encode("latin-1"))
    last = readers.load_table(spark, str(path)).where("id = 2000").first()
    assert last.name == "caf\u00e9"
    assert readers.load_table(spark, str(path), sep=",", encoding="ISO-8859-1").count() == 2001


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,name\n1,"two\nlines"\n2,"say ""a, b"""\n3,x\n')
    rows = readers.load_table(spark, str(tmp_path / "q.csv")).orderBy("id").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "two\nlines"), (2, 'say "a, b"'), (3, "x")]


def test_records_that_do_not_fit(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,name\n1,x\n2,y,z\n3,w\n")
    rows = readers.load_table(spark, str(tmp_path / "bad.csv"), corrupt_column="_bad").orderBy("id").collect()
    assert [(r.id, r._bad) for r in rows] == [(1, None), (2, "2,y,z"), (3, None)]


def test_folders_are_whole_tables(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('n', id) AS name").repartition(4)
    for fmt in ("csv", "json", "parquet"):
        df.write.option("header", True).format(fmt).save(str(tmp_path / fmt))
        assert readers.load_table(spark, str(tmp_path / fmt)).agg({"id": "sum"}).first()[0] == 499_500
        assert readers.load_table(spark, str(tmp_path / fmt), number=1).count() < 1000
    (tmp_path / "mixed").mkdir()
    for name in ("a.csv", "b.json"):
        (tmp_path / "mixed" / name).write_text('{"k": 1}')
    with pytest.raises(ValueError):
        readers.load_table(spark, str(tmp_path / "mixed"))


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "a.json").write_text(' [{"k": 1},\n {"k": 2}]')
    assert [readers.load_table(spark, str(tmp_path / n)).count() for n in ("l.json", "a.json")] == [2, 2]


def test_json_parquet_and_file_choice(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "notes.txt").write_text("no table")
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    (tmp_path / "a.csv").write_text("k,v\n5,x\n")
    folder = str(tmp_path)
    assert [readers.load_table(spark, folder, number=n).count() for n in (1, 2, 3, 0)] == [1, 2, 3, 3]
    with pytest.raises(IndexError):
        readers.pick_file(spark, folder, 4)
    with pytest.raises(FileNotFoundError):
        readers.load_table(spark, folder + "/missing")


def test_copies_and_targets(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a, b"'), (2, None)], "id int, t string")
    for fmt in ("csv", "parquet"):
        sinks.write_table(df, str(tmp_path / fmt), fmt)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', inferSchema=True)
    assert back.orderBy("id").collect() == df.orderBy("id").collect()
    target = spark.createDataFrame([(1, 7)], "id int, y int")
    joined = readers.attach_target(df, target, "id", "label").orderBy("id").collect()
    assert [(r.id, r.label) for r in joined] == [(1, 7), (2, None)]


def test_manifest():
    good, bad = read_manifest("""{
        "/data/a": {"target_column": " y ", "no_dataset": 2, "timeout": 60},
        "/data/b": {"platform": "p"}, "/data/c": {"target_column": "y", "model_type": "Forest"},
        "/data/d": {"target_column": "y", "model_type": "Support Vector Machine", "platform": "p"}}""")
    assert good == [Entry("/data/a", "y", 2, "Logistic Regression", 60),
                    Entry("/data/d", "y", None, "Support Vector Machine", 3600, "p")]
    assert Entry("/data/a", "y") != Entry("/data/a", "y", 1)
    assert [b[0] for b in bad] == ["/data/b", "/data/c"]


def test_time_limit_cancels_jobs(spark):
    with pytest.raises(batch.Expired):
        run_with_limit(spark, 1.0, lambda: spark.range(10**13).selectExpr("sum(id % 7)").collect())
    assert run_with_limit(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        run_with_limit(spark, 60, lambda: 1 // 0)


def test_batch_records_failures_and_reports(spark, sf_dir, tmp_path):
    orders = orders_wide(spark, sf_dir).select("row_id", "total", "balance", "race", "age", "signal_label")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    entries = [
        Entry(str(tmp_path / "orders.parquet"), "signal_label", platform="p", row_id="row_id"),
        Entry(str(tmp_path / "orders.parquet"), "no_such", platform="q"),
        Entry(str(tmp_path / "gone.parquet"), "y", platform="q"),
    ]
    report, status = batch_audit(spark, entries, AuditConfig(), [("x", "invalid model")])
    states = {(r.dataset.rsplit("/", 1)[-1], r.part): r.status for r in status.collect()}
    assert states[("gone.parquet", "load")] == "failed" and states[("x", "manifest")] == "refused"
    assert states[("orders.parquet", "quality")] == states[("orders.parquet", "fairness")] == "done"
    sinks.write_report(report, str(tmp_path / "report"))
    sections = {r.section for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert sections == {"overview", "column_types", "columns", "alerts", "f1_report", "outlier_summary",
                        "top_patterns", "group_fairness", "precision_by_group", "influence_fairness"}


def test_timeout_is_recorded(spark, sf_dir):
    entry = Entry("orders", "signal_label", row_id="row_id", timeout=0)
    report, status = audit_dataset(spark, entry, load=lambda s, _: orders_wide(s, sf_dir))
    assert report is None and {s[2] for s in status} == {"timeout"}


def test_roll_up(spark):
    rows = [("a", "p", "f1_report", "", "f1_orig", "0.5"), ("a", "p", "f1_report", "", "f1_statistic", "0.6"),
            ("a", "p", "f1_report", "", "f1_influence", "0.4"), ("b", "q", "f1_report", "", "f1_orig", "0.5"),
            ("b", "q", "f1_report", "", "f1_statistic", "0.5"), ("b", "q", "f1_report", "", "f1_influence", "0.5"),
            ("a", "p", "group_fairness", "sex", "DPD_fair", "false"), ("a", "p", "group_fairness", "sex", "EOD_fair", "true")]
    report = spark.createDataFrame(rows, "dataset string, platform string, section string, item string, metric string, value string")
    total = roll_up(report).where("platform IS NULL").first()
    assert (total.datasets, total.statistic_best_pct, total.equal_pct, total.unfair_columns_pct) == (2, 50.0, 50.0, 50.0)
    assert total.statistic_f1_change == pytest.approx(5.0)


def test_a_large_table_is_not_one_task(spark, tmp_path, monkeypatch):
    path = tmp_path / "docs.parquet"
    spark.range(20000).repartition(6).write.parquet(str(path))
    stored = sum(f.stat().st_size for f in path.glob("*.parquet")) / 1e6
    df = spark.read.parquet(str(path))
    assert source_queries._few_files(df).rdd.getNumPartitions() == 1
    for files in (3, 40):
        monkeypatch.setattr(source_queries, "FILE_MB", stored / files)
        parts = source_queries._few_files(df).rdd.glom().map(len).collect()
        assert files <= len(parts) <= files + 1 and sum(parts) == 20000 and max(parts) <= 3 * 20000 / files


def test_large_quoted_files_are_read_whole(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(source_queries, "FILE_MB", 0.05)
    found = source_queries.source_csv_one_large_file(spark, sf_dir)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = source_queries._folder(spark, "documents-one.csv")
    assert len(spark.read.text(folder).inputFiles()) > 2
    assert found.exceptAll(given.select(found.columns)).isEmpty() and found.count() == given.count()
