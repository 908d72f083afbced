"""Invariants of feature preparation, over the given tables and over edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import c
from plumbline.operators import text
from plumbline.operators.profile import collect_roles
from plumbline.plans.features import build_features
from workloads.fixtures import doc_labels, events_num, orders_wide

CASES = {
    "orders": (lambda s, d: orders_wide(s, d).drop("pred", "target"), "signal_label"),
    "documents": (lambda s, d: doc_labels(s, d).drop("pred"), "quality"),
    "events": (lambda s, d: events_num(s, d), "value"),
}


@pytest.mark.parametrize("mode", ["quality", "fairness"])
@pytest.mark.parametrize("case", CASES)
def test_prepared_table(spark, sf_dir, case, mode):
    load, target = CASES[case]
    df = load(spark, sf_dir)
    done = build_features(df, "row_id", target, mode)
    rows = done.data.select("row_id", "label", "features").collect()
    assert len(rows) == df.count() == len({r.row_id for r in rows})
    assert {r.label for r in rows} == {0, 1}
    m = np.array([r.features.toArray() for r in rows])
    assert m.shape[1] == len(done.design.names) and np.isfinite(m).all()
    assert len(set(done.design.names)) == len(done.design.names)
    w = np.linspace(-1, 1, m.shape[1])
    dots = done.data.select("row_id", done.design.dot(w).alias("d")).collect()
    assert np.allclose([r.d for r in sorted(dots)], [r.features.toArray() @ w for r in sorted(rows, key=lambda r: r.row_id)])
    if mode == "fairness":
        numeric = [i for i, n in enumerate(done.design.names) if n in done.roles.numeric and n not in done.sensitive]
        assert np.allclose(m[:, numeric].mean(0), 0, atol=1e-9) and np.allclose(m[:, numeric].std(0), 1)
        assert set(done.sensitive) == set(done.roles.sensitive)


def test_categories_without_one_hot(spark, sf_dir):
    done = build_features(orders_wide(spark, sf_dir).drop("pred", "target"), "row_id", "signal_label", "quality",
                          one_hot_encode=False)
    assert not len(done.design) and len(done.categorical) == 5
    for name in done.categorical:
        assert done.data.where(c(name).isNull()).count() == 0


def test_positive_class_and_unknown_mode(spark, sf_dir):
    df = orders_wide(spark, sf_dir).drop("pred", "target", "signal_label")
    done = build_features(df, "row_id", "priority", "quality", positive="1-URGENT")
    assert done.data.agg(F.sum("label")).first()[0] == df.where("priority = '1-URGENT'").count()
    with pytest.raises(ValueError, match="unknown mode"):
        build_features(df, "row_id", "priority", "other")


def test_awkward_names_and_gaps(spark):
    rows = [(i, float(i % 17) if i % 5 else None, f"{i % 23}" if i % 7 else "N/A", ["a", "b", "?"][i % 3], 1.0, i % 2)
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, `a.b` double, `c (%)` string, `d/e` string, same double, `t?` int")
    roles = collect_roles(df.drop("id"), "t?")
    assert (roles.numeric, roles.categorical, roles.dropped) == (["a.b", "c (%)"], ["d/e"], ["same"])
    for mode in ("quality", "fairness"):
        done = build_features(df, "id", "t?", mode)
        names = done.design.names
        assert names == ["d/e_<MISSING>", "d/e_a", "d/e_b", "a.b", "c (%)"]
        assert done.data.where(F.col("features").isNull()).count() == 0


def test_target_with_one_class_left(spark):
    df = spark.createDataFrame([(i, float(i % 13), 5.0 if i < 90 else float(i)) for i in range(120)],
                               "id long, x double, y double")
    with pytest.raises(ValueError, match="one class"):
        build_features(df, "id", "y", "quality")


def test_too_many_categories_are_refused(spark):
    from plumbline.operators.encoding import categories

    df = spark.createDataFrame([(f"v{i}",) for i in range(30)], "x string")
    with pytest.raises(ValueError, match="more than 20"):
        categories(df, ["x"], 20)
    assert len(categories(df, ["x"], 30)["x"]) == 30


def test_text_model_equals_dense_algebra(spark):
    words = "red green blue dog cat bird tree stone river of the and".split()
    rng = np.random.default_rng(4)
    docs = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(80)] + [None, "", "!! a b"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    model = text.fit_text(df, "t", max_terms=10)
    counts = {}
    for d in docs:
        for w in (d or "").split():
            if len(w) > 1:
                counts[w] = counts.get(w, 0) + 1
    terms = sorted(sorted(counts, key=lambda w: (-counts[w], w))[:10])
    assert list(model.vocab.terms) == terms
    tf = np.array([[(d or "").split().count(t) for t in terms] for d in docs], float)
    idf = np.log((1 + len(docs)) / (1 + (tf > 0).sum(0))) + 1
    w = tf * idf
    size = np.linalg.norm(w, axis=1, keepdims=True)
    w = w / np.where(size == 0, 1, size)
    _, _, vt = np.linalg.svd(w, full_matrices=False)
    v = vt[:2].T
    v = v * np.sign(v[np.abs(v).argmax(0), [0, 1]])
    assert np.allclose(model.vocab.idf, idf) and np.allclose(model.loadings, v, atol=1e-6)
    rows = text.text_components(df, "t", model).orderBy("id").collect()
    assert np.allclose([[r.t_svd_0, r.t_svd_1] for r in rows], w @ v, atol=1e-6)
    weights = text.tfidf(df, "id", "t", vocab=model.vocab).collect()
    assert len(weights) == (w > 0).sum()
    assert all(abs(r.weight - w[r.row_id, terms.index(r.term)]) < 1e-9 for r in weights)


def test_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, "!")], "id int, t string")
    model = text.fit_text(df, "t")
    assert [(r.t_svd_0, r.t_svd_1) for r in text.text_components(df, "t", model).collect()] == [(0.0, 0.0)] * 2
    assert text.tfidf(df, "id", "t").count() == 0


def test_components_have_small_residuals_and_few_passes(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 6)) @ (rng.normal(size=(6, 80)) * np.array([9, 5, 4, 1, 0.5, 0.1])[:, None]) + 0.01 * rng.normal(size=(300, 80))
    a[rng.random(a.shape) < 0.3] = 0
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in a] + [([], [])], "indices array<int>, values array<double>")
    found = text.leading_components(rows.repartition(3), 80, 3, block=8)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(found.squares, s[:3] ** 2) and found.passes <= 10
    assert np.allclose(np.abs((vt[:3] * found.vectors.T).sum(axis=1)), 1)
    gap = np.linalg.norm(a.T @ (a @ found.vectors) - found.vectors * found.squares, axis=0)
    assert gap.max() <= 1e-8 * s[0] ** 2 and found.residuals.max() <= text.TOLERANCE * found.squares.max()
    assert text.leading_components(rows.where("false"), 80, 2).squares.tolist() == [0, 0]
    with pytest.raises(RuntimeError, match="not found in 1 pass"):
        text.leading_components(rows, 80, 3, block=4, most_passes=1)


def test_two_text_columns_are_fitted_at_the_same_time(spark):
    from concurrent.futures import ThreadPoolExecutor

    words = ["red", "green", "blue", "cyan", "pink", "grey"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, 9)), " ".join(rng.choice(words[2:], 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    alone = [text.fit_text(df, n) for n in ("s", "t")]
    with ThreadPoolExecutor(2) as pool:
        together = list(pool.map(lambda n: text.fit_text(df, n), ("s", "t")))
    for x, y in zip(alone, together):
        assert x.vocab == y.vocab and np.allclose(x.loadings, y.loadings, atol=1e-8)


@pytest.mark.parametrize("name", ["sensitive_groups", "features_fairness"])
def test_audited_orders_are_joined_once(spark, sf_dir, name):
    import __spark_entry__ as entry

    found = entry.queries()[name](spark, sf_dir)
    assert not any("customer" in f for f in found.inputFiles())


def test_texts_are_searched_for_tokens_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def given(text):
        seen.add(1)
        return text

    df = spark.createDataFrame([(f"word{i % 7} and word{i % 3} more",) for i in range(60)], "t string").repartition(3)
    model = text.fit_text(df.select(given("t").alias("t")), "t")
    assert seen.value <= 60 and "word6" in model.vocab.terms
    assert model.vocab == text.fit_vocabulary(df, "t")
