import pytest

from plumbline.functions.sensitive import sensitive_kind
from plumbline.operators import binning, describe, profile
from plumbline.operators.split import hash_split, stratified_split, with_row_id


def _summary(df):
    return {r.metric: r.value for r in profile.dataset_summary(df).collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    found = _summary(df)
    assert found["Number of Records"] == "0" and found["Missing Percentage"] == "0.00%"
    assert found["Average Record Size"] == "0.00 Bytes"
    assert {r.code for r in profile.alerts(df).collect()} == {"all_missing"}
    assert {r.role for r in profile.column_roles(df).collect()} == {"dropped"}
    assert binning.histogram(df, "a").count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    codes = {(r.level, r.code) for r in profile.alerts(df).collect()}
    assert codes == {("info", "complete"), ("info", "all_unique"), ("info", "single_value")}


def test_nan_counts_as_missing_and_copies_are_counted(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("nan"), None), (None, None)], "x double, s string")
    found = _summary(df)
    assert found["Missing Cells"] == "4" and found["Duplicate Records"] == "1"


def test_alert_levels(spark):
    rows = [(f"v{i}" if i else "x" * 276, "y" * 101, None, str(i) if i % 2 else "word", 1.0 if i < 3 else None, i)
            for i in range(20)]
    df = spark.createDataFrame(rows, "long string, wide string, none string, mixed string, gaps double, id int")
    found = [(r.level, r.col, r.code) for r in profile.alerts(df).collect()]
    assert ("error", "long", "long_text") in found and ("error", "none", "all_missing") in found
    assert ("error", "wide", "constant") in found  # errors hide its long text warning
    assert ("error", "gaps", "mostly_missing") in found and ("warning", "mixed", "mixed_types") in found
    assert [f[0] for f in found] == sorted((f[0] for f in found), key=["error", "warning", "info"].index)
    text = {r.code: r.message for r in profile.alerts(df).collect() if r.col in ("gaps", "long")}
    assert text["mostly_missing"] == 'Column "gaps" has more than 70% missing values (85.00%)'
    assert text["long_text"] == 'Column "long" contains long strings (up to 276 characters)'


def test_text_and_numbers_as_text(spark):
    rows = [(f"name {i}", str(i) if i % 4 else "NA", str(i % 3), i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "name string, num string, few string, flag boolean")
    roles = {r.col: r.role for r in profile.column_roles(df).collect()}
    assert roles == {"name": "text", "num": "numeric", "few": "categorical", "flag": "categorical"}


@pytest.mark.parametrize(("name", "match", "kind"), [
    ("Sex", "substring", "gender"), ("native.country", "substring", "national_origin"), ("wage", "substring", "age"),
    ("wage", "token", "socioeconomic"), ("page_id", "token", None), ("current_age", "token", "age"), ("height", "substring", None),
])
def test_sensitive_names(name, match, kind):
    assert sensitive_kind(name, match) == kind


def test_value_counts_with_null_and_without_rest(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    rows = [(r.value, r.n, r.pct, r.folded) for r in profile.top_value_counts(df, "x", 2).collect()]
    assert rows == [("a", 2, 50.0, False), (None, 1, 25.0, False), ("Other", 1, 25.0, True)]
    assert not any(r.folded for r in profile.top_value_counts(df, "x", 5).collect())


def test_correlation_needs_both_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    found = {(r.col_a, r.col_b): round(r.corr, 9) for r in describe.correlation_matrix(df).collect()}
    assert found == {("a", "a"): 1.0, ("a", "b"): 1.0, ("b", "a"): 1.0, ("b", "b"): 1.0}


@pytest.mark.parametrize("settle", [10, 100_000])
def test_exact_split_by_prefixes(spark, monkeypatch, settle):
    """Counting prefixes gives the same rows as sorting, and exact shares."""
    import plumbline.operators.split as split

    monkeypatch.setattr(split, "_SETTLE_ROWS", settle)
    df = spark.range(5000).selectExpr("id", "int(id % 3 = 0) AS y", "id % 2 = 0 AS z")
    for label in ("y", "z"):
        rows = stratified_split(df, "id", label).groupBy(label).agg({"*": "count"}).collect()
        found = {(r[label], r.is_test): r["count"] for r in
                 stratified_split(df, "id", label).groupBy(label, "is_test").count().collect()}
        for r in rows:
            assert found[r[label], True] == int(r["count(1)"] * 0.2 + 0.5)


def test_row_ids_and_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(300)], "a int, b string")
    seen = {frozenset((r.row_id, r.is_test) for r in hash_split(with_row_id(df.repartition(p)), "row_id").collect())
            for p in (1, 4, 64)}
    assert len(seen) == 1 and len(next(iter(seen))) == 300
