from itertools import combinations

import numpy as np
import pytest

from plumbline.functions.columns import c
from plumbline.operators import fairness, patterns


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    n = 400
    return [
        (str(rng.choice(["x", "y", "z"], p=[0.5, 0.3, 0.2])), str(rng.choice(list("abcdef"))),
         str(rng.choice(["u", "w"])) if rng.random() > 0.1 else None, float(rng.normal()))
        for _ in range(n)
    ]


SCHEMA = "p string, q string, r string, influence double"


def _brute(rows, size, least):
    found = {}
    for names in combinations(range(3), size):
        for row in rows:
            values = tuple(row[i] for i in names)
            if None not in values:
                n, s = found.get((names, values), (0, 0.0))
                found[names, values] = (n + 1, s + row[3])
    total = abs(sum(r[3] for r in rows))
    return {
        " AND ".join(f"{'pqr'[i]} = {v}" for i, v in zip(*key)): (round(n / len(rows), 4), s / total)
        for key, (n, s) in found.items() if n >= least * len(rows)
    }


@pytest.mark.parametrize(("parts", "listed"), [(1, 100_000), (32, 0)])
def test_conjunctions_equal_brute_force(spark, rows, parts, listed, monkeypatch):
    monkeypatch.setattr(patterns, "_MAX_LISTED", listed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = patterns.top_patterns(df, [], 0.03, None, max_predicates=3).collect()
    want = {k: v for size in (1, 2, 3) for k, v in _brute(rows, size, 0.03).items()}
    assert {r.pattern for r in found} == set(want)
    for r in found:
        assert r.support == pytest.approx(want[r.pattern][0], abs=1e-4)
        assert r.responsibility == pytest.approx(want[r.pattern][1], abs=1e-4)


def test_hash_buckets_lose_no_frequent_value(spark):
    rows = [("hot" if i % 3 == 0 else f"t{i}", float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "text string, influence double")
    plain = patterns.top_patterns(df, [], 0.05, 5).collect()
    wide = patterns.top_patterns(df, [], 0.05, 5, wide=("text",)).collect()
    assert plain == wide and [r.pattern_val_1 for r in wide] == ["hot"]


def test_ties_go_by_pattern(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "k string, influence double")
    found = patterns.top_patterns(df, [], 0.0, 2).collect()
    assert [r.pattern for r in found] == ["k = a", "k = b"]


@pytest.mark.parametrize(("value", "want"), [
    ("(1, 2]", [2.0]), ("[1, 2]", [1.0, 2.0]), ("[1.0, 2)", [1.0]), ("(-1e-3, 1e0]", [0.0, 1.0]), ("3.0", [3.0]),
])
def test_predicates(spark, value, want):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, None)], "x double")
    assert sorted(r.x for r in df.where(patterns.predicate("x", value, df.schema)).collect()) == want


def test_negated_predicate_keeps_unknown_values(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert df.where(~patterns.predicate("x", "a", df.schema)).count() == 1


def test_effect_size_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "k string, influence double")
    one = fairness.influence_effects(df, [("k", "a"), ("k", "none")]).collect()
    # A group of one has no deviation: no effect size.
    assert (one[0].cohen_d, one[0].mean_positive_group, one[0].mean_other) == (0.0, 1.0, 3.0)
    # A group without rows has none either, and is no evidence of fairness.
    assert one[1].cohen_d is None and one[1].mean_positive_group is None and not one[1].cohen_fair


def test_text_that_looks_like_an_interval(spark):
    df = spark.createDataFrame([("(1, 2]", 5.0), ("(1, 2]", 6.0), ("x", 0.0), ("x", 1.0)], "k string, influence double")
    found = fairness.influence_effects(df, [("k", "(1, 2]")]).first()
    assert found.mean_positive_group == 5.5 and found.mean_other == 0.5 and not found.cohen_fair
    top = patterns.top_patterns(df, [], 0.1, 1).first()
    assert (top.pattern_val_1, top.support) == ("(1, 2]", 0.5)
    assert patterns.parse_interval("[-1e3, .5)") == (True, -1000.0, 0.5, False)
    assert patterns.parse_interval("(a, 2]") is None and patterns.parse_interval("(1, 2, 3]") is None


def test_conjunctions_need_a_support(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "k string, l string, influence double")
    with pytest.raises(ValueError):
        patterns.top_patterns(df, [], 0.0, 5, max_predicates=2)


def test_effects_by_value_equal_direct_effects(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    direct = fairness.influence_effects(df, [("q", v) for v in "abcdef"]).orderBy("positive_group").collect()
    grouped = fairness.influence_effects_by_value(df, ["q"]).orderBy("positive_group").collect()
    assert np.allclose([r.cohen_d for r in direct], [r.cohen_d for r in grouped])


def test_no_predicted_positive_counts_as_zero(spark):
    rows = [("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 1, 1), (None, 0, 1)]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    rec = fairness.fairness_records(df, ["g"], "y", "p").first()
    assert rec.DPD == 1.0 and rec.EOD == 1.0 and rec.PPV_diff == 1.0
    rows = fairness.predictive_parity(df, ["g"], "y", "p").collect()
    assert {r.grp: (r.ppv, r.fair) for r in rows} == {"a": (0.0, False), "b": (1.0, True), "nan": (0.0, False)}
    assert fairness.group_metric(df, "g", n=fairness.F.count(c("y"))).count() == 3


def test_precision_of_very_many_groups(spark):
    df = spark.range(10_001).selectExpr("concat('g', id) AS g", "1 AS y", "cast(id % 2 AS int) AS p")
    rows = fairness.predictive_parity(df, ["g"], "y", "p")
    assert rows.count() == 10_001 and rows.where("ppv is null or fair is null").count() == 0
    assert fairness.fairness_records(df, ["g"], "y", "p").first().PPV_diff == 1.0
