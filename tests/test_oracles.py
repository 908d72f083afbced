"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from oracle_check import check

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    found, _, _, _ = check(spark, sf_dir, name)
    assert found == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    found, rows, _, _ = check(spark, sf_dir, name)
    assert found is None and rows > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
