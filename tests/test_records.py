"""Framing of records across splits, against readers that see whole files."""

import csv
import json
import random

import pytest

from plumbline.sources import readers, records


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "1500")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def odd_values(rng, n):
    pieces = ["plain", 'say "hi"', "two\nlines", "a,b", "\r\nwindows\r\n", '"', '""', "", "{[}", "}]", "\\", 'back\\"slash', "é中\U0001f600", " x ", "\n\n", "\t"]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("end, sep, encoding", [("\n", ",", "utf-8"), ("\r\n", ";", "utf-8"), ("\n", "|", "utf-8-sig"), ("\n", "\t", "latin-1")])
def test_quoted_breaks_across_splits(spark, tmp_path, small_splits, end, sep, encoding):
    rng = random.Random(4)
    values = odd_values(rng, 250)
    if encoding == "latin-1":
        values = [v.replace("中", "ü").replace("\U0001f600", "ß") for v in values]
    values[50] = "long " * 600 + "\n" + "tail, \"quoted\" " * 300  # spans many splits
    rows = [(str(i), v, "end") for i, v in enumerate(values)]
    for number in (1, 2):
        with open(tmp_path / f"{number}.csv", "w", newline="", encoding=encoding) as file:
            writer = csv.writer(file, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC)
            writer.writerow(["id", "text\nof it", "z"])
            writer.writerows(rows)
    df = readers.load_table(spark, str(tmp_path), sep=sep, encoding={"latin-1": "ISO-8859-1"}.get(encoding))
    assert df.columns == ["id", "text\nof it", "z"] and dict(df.dtypes)["id"] == "int"
    got = sorted((r[0], r[1] or "", r[2]) for r in df.collect())
    want = sorted([(int(i), v, z) for i, v, z in rows] * 2)
    # The engine trims nothing inside quotes; empty values are null in either.
    assert got == want
    assert records.records(spark, [str(tmp_path / "1.csv")], records.csv_framing(sep)).rdd.getNumPartitions() > 8


def test_stray_quotes_open_nothing(spark, tmp_path, small_splits):
    body = 'id,size\n1,5" disk\n2,"broken\nline"\n3,3.5" and 7" disks\n' + "".join(f'{i},"{i}"" x\n"\n' for i in range(4, 90))
    (tmp_path / "a.csv").write_text(body)
    rows = dict(tuple(r) for r in readers.load_table(spark, str(tmp_path / "a.csv")).collect())
    assert len(rows) == 89 and rows[1] == '5" disk' and rows[3] == '3.5" and 7" disks' and rows[2] == "broken\nline" and rows[50] == '50" x\n'


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_across_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(7)
    rows = [{"id": i, "text": v, "deep": {"a": [{"b": v}, {"c": [1, 2]}], "d": {}}} for i, v in enumerate(odd_values(rng, 300))]
    rows[20]["text"] = "{" * 900 + '"}' * 700
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n [ ]\n")
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1000, "text": "one"}]))
    df = readers.load_table(spark, str(tmp_path))
    got = {r["id"]: r for r in df.collect()}
    assert len(got) == 301 and got[1000]["text"] == "one"
    assert all(got[r["id"]]["text"] == r["text"] and got[r["id"]]["deep"]["a"][0]["b"] == r["deep"]["a"][0]["b"] for r in rows)
    assert records.records(spark, [str(tmp_path / "a.json")], records.json_framing()).rdd.getNumPartitions() > 8


def test_broken_records_are_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": }, {"k": 3}, {"k": 4')
    rows = readers.load_table(spark, str(tmp_path / "a.json"), schema="k int, bad string", corrupt_column="bad").collect()
    assert sorted((r["k"] or 0, r["bad"] is None) for r in rows) [:3] == [(0, False), (1, True), (3, True)]
    (tmp_path / "b.csv").write_text('id,name\n1,"x\ny"\n2,y,z\n3,"open\n')
    rows = {r["id"]: r for r in readers.load_table(spark, str(tmp_path / "b.csv"), corrupt_column="bad").collect()}
    assert rows[1]["name"] == "x\ny" and rows[2]["bad"] == "2,y,z" and 3 in rows


def test_files_of_two_delimiters_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("id;name\n2;y\n")
    with pytest.raises(ValueError, match="delimited by"):
        readers.load_table(spark, str(tmp_path))
