"""Physical plans keep their promises: pruned scans, no products, no single-task windows."""

import pytest

import __spark_entry__ as entry

LAZY = ["duplicate_rows", "dataset_summary", "column_roles", "alerts", "fairness_classical", "predictive_parity",
        "group_metric", "value_counts_topn", "f1", "correlation", "null_or_empty", "hash_split", "attach_target"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_windows(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert word not in plan


def test_scans_read_the_needed_columns(spark, sf_dir):
    plan = _plan(entry.queries()["duplicate_rows"](spark, sf_dir))
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {part.split(":")[0] for part in read.split(",")} == {"l_quantity", "l_discount", "l_returnflag", "l_linestatus"}


def test_filters_reach_the_scan(spark, sf_dir):
    from workloads.fixtures import table

    plan = _plan(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_tax"))
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_shipdate" not in plan


def test_split_needs_no_shuffle(spark, sf_dir):
    from plumbline.operators.split import hash_split

    plan = _plan(hash_split(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey"))
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", LAZY)
def test_no_rows_are_dealt_round_robin(spark, sf_dir, name):
    assert "RoundRobin" not in _plan(entry.queries()[name](spark, sf_dir))


def test_text_weights_stay_in_the_jvm(spark, sf_dir):
    plan = _plan(entry.queries()["tfidf"](spark, sf_dir))
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
