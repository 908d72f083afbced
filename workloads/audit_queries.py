"""Fitted models and whole audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import models, outliers, svm
from plumbline.plans.audits import fairness_audit, fit_audit, flag_outliers, quality_audit
from plumbline.plans.batch import Entry, batch_audit, roll_up
from plumbline.session import materialise
from plumbline.sources.sinks import tidy
from workloads.fixtures import doc_labels, events_num, orders_wide
from workloads.model_queries import SCALED_ORDERS, _DESIGN, _halves, _scaled_orders
from workloads.registry import query


def newton_sql(name: str, source: str, keep: str, penalty1: str, penalty2: str, steps: int = 9) -> str:
    """CTEs that fit label ~ z1, z2 by Newton steps; the last one is ``name``."""
    parts = [f"{name}0 AS (SELECT 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(f"""{name}g{k} AS MATERIALIZED (
  SELECT w1, w2, b, sum((p - label) * z1) + w1 * ({penalty1}) AS g1, sum((p - label) * z2) + w2 * ({penalty2}) AS g2, sum(p - label) AS g3,
    sum(q * z1 * z1) + ({penalty1}) AS a11, sum(q * z1 * z2) AS a12, sum(q * z1) AS a13,
    sum(q * z2 * z2) + ({penalty2}) AS a22, sum(q * z2) AS a23, sum(q) AS a33
  FROM (SELECT *, p * (1 - p) AS q FROM (
    SELECT z1, z2, label, w1, w2, b, 1 / (1 + exp(-(w1 * z1 + w2 * z2 + b))) AS p FROM {source}, {name}{k} WHERE {keep}))
  GROUP BY w1, w2, b),
{name}{k + 1} AS MATERIALIZED (
  SELECT w1 - (g1 * (a22 * a33 - a23 * a23) - a12 * (g2 * a33 - a23 * g3) + a13 * (g2 * a23 - a22 * g3)) / det AS w1,
    w2 - (a11 * (g2 * a33 - g3 * a23) - g1 * (a12 * a33 - a23 * a13) + a13 * (a12 * g3 - g2 * a13)) / det AS w2,
    b - (a11 * (a22 * g3 - a23 * g2) - a12 * (a12 * g3 - g2 * a13) + g1 * (a12 * a23 - a22 * a13)) / det AS b
  FROM (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det
    FROM {name}g{k}))""")
    parts.append(f"{name} AS (SELECT * FROM {name}{steps})")
    return ",\n".join(parts)


@query(f"""
WITH {SCALED_ORDERS}, z AS (SELECT x1 AS z1, x2 AS z2, label FROM d WHERE NOT is_test),
{newton_sql('fit', 'z', 'TRUE', '1', '1')}
SELECT unnest(['x1', 'x2', 'intercept']) AS term, round(unnest([w1, w2, b]), 4) AS weight FROM fit
""")
def logistic_fit(spark, sf_dir):
    train, _ = _halves(_scaled_orders(spark, sf_dir))
    model = models.fit(train, "logistic", _DESIGN)
    return _weights(spark, model)


def _svm_sql(steps: int) -> str:
    """CTEs t (training rows), p (weights) and fit: the hinge loss rounded off ever less, by Newton steps of the best of some lengths."""
    loss = "CASE WHEN s >= {w} THEN s - {w} / 2 WHEN s > 0 THEN s * s / (2 * {w}) ELSE 0 END"
    parts = ["""
t AS MATERIALIZED (SELECT x1, x2, (2 * label - 1)::DOUBLE AS y FROM d WHERE NOT is_test),
c AS (SELECT 1.0::DOUBLE / count(*) AS c FROM t),
p0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b)"""]
    r = 0
    for width in svm.WIDTHS:
        w = f"{width!r}::DOUBLE"
        for _ in range(steps):
            parts.append(f"""
h{r} AS (SELECT any_value(c) * any_value(w1) - avg(a * y * x1) AS g1, any_value(c) * any_value(w2) - avg(a * y * x2) AS g2, -avg(a * y) AS g3,
    any_value(c) + avg(z * x1 * x1) AS h11, avg(z * x1 * x2) AS h12, avg(z * x1) AS h13, any_value(c) + avg(z * x2 * x2) AS h22, avg(z * x2) AS h23, avg(z) + 1e-6 AS h33
  FROM (SELECT *, least(greatest(s / {w}, 0), 1) AS a, CASE WHEN s > 0 AND s < {w} THEN 1 / {w} ELSE 0 END AS z
    FROM (SELECT *, 1 - y * (w1 * x1 + w2 * x2 + b) AS s FROM t, p{r}, c))),
q{r} AS MATERIALIZED (SELECT
    -(g1 * (h22 * h33 - h23 * h23) - g2 * (h12 * h33 - h13 * h23) + g3 * (h12 * h23 - h13 * h22)) / e AS d1,
    -(-g1 * (h12 * h33 - h13 * h23) + g2 * (h11 * h33 - h13 * h13) - g3 * (h11 * h23 - h12 * h13)) / e AS d2,
    -(g1 * (h12 * h23 - h13 * h22) - g2 * (h11 * h23 - h12 * h13) + g3 * (h11 * h22 - h12 * h12)) / e AS d3
  FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h13 * h23) + h13 * (h12 * h23 - h13 * h22) AS e FROM h{r})),
e{r} AS MATERIALIZED (SELECT l, any_value(c) / 2 * (power(any_value(w1 + l * d1), 2) + power(any_value(w2 + l * d2), 2)) + avg({loss.format(w=w)}) AS v
  FROM (SELECT *, 1 - y * ((w1 + l * d1) * x1 + (w2 + l * d2) * x2 + b + l * d3) AS s
    FROM t, p{r}, q{r}, c, (SELECT unnest([1, 0.5, 0.25, 0.1, 0.01, 1e-3, 1e-4, 0]::DOUBLE[]) AS l)) GROUP BY l),
p{r + 1} AS MATERIALIZED (SELECT w1 + l * d1 AS w1, w2 + l * d2 AS w2, b + l * d3 AS b FROM p{r}, q{r}, (SELECT arg_min(l, v) AS l FROM e{r}))""")
            r += 1
    parts.append(f"""
fit AS (SELECT any_value(c) / 2 * (any_value(w1 * w1) + any_value(w2 * w2)) + avg(greatest(s, 0)) AS primal,
    avg(a) - (power(avg(a * y * x1), 2) + power(avg(a * y * x2), 2)) / (2 * any_value(c)) AS dual
  FROM (SELECT *, least(greatest(s / {svm.WIDTHS[-1]!r}::DOUBLE, 0), 1) AS a FROM (SELECT *, 1 - y * (w1 * x1 + w2 * x2 + b) AS s FROM t, p{r}, c)))""")
    return ",".join(parts)


@query(f"WITH {SCALED_ORDERS}, {_svm_sql(10)} SELECT round(primal, 5) AS primal, round(dual, 3) AS dual, primal - dual BETWEEN -1e-9 AND 1e-4 AS certified FROM fit")
def svm_certificate(spark, sf_dir):
    """Objective of the support vector machine and the dual's value, which bounds it from below."""
    train, _ = _halves(_scaled_orders(spark, sf_dir))
    found = svm.fit_svm(train, 1.0 / train.count(), gap=0.0)
    row = [(found.primal, found.dual, -1e-9 <= found.gap <= 1e-4)]
    return spark.createDataFrame(row, "primal double, dual double, certified boolean").select(
        F.round("primal", 5).alias("primal"), F.round("dual", 3).alias("dual"), "certified")


@query(f"""
WITH {SCALED_ORDERS}, {_svm_sql(10)}, last AS (SELECT * FROM p{10 * len(svm.WIDTHS)})
SELECT 'x1' AS term, round(w1, 3) AS weight FROM last UNION ALL SELECT 'x2', round(w2, 3) FROM last UNION ALL SELECT 'intercept', round(b, 3) FROM last
""")
def svm_fit(spark, sf_dir):
    train, _ = _halves(_scaled_orders(spark, sf_dir))
    return _weights(spark, models.fit(train, "svm", _DESIGN, gap=0.0)).select("term", (F.round("weight", 3) + F.lit(0.0)).alias("weight"))


def _weights(spark, model):
    rows = [*zip(_DESIGN.names, model.weights), ("intercept", model.intercept)]
    table = spark.createDataFrame(rows, "term string, weight double")
    return table.select("term", F.round("weight", 4).alias("weight"))


# The quality audit of two numeric columns, step by step: medians, majority label, exact
# stratified split, fit, Mahalanobis and influence flags, two refits, F1 on the test rows.
_AUDIT = f"""
med AS (SELECT quantile_cont(total, 0.5) AS t, quantile_cont(balance, 0.5) AS bal FROM orders_wide),
top AS (SELECT signal_label AS v FROM orders_wide GROUP BY 1 ORDER BY count(*) DESC, CAST(signal_label AS VARCHAR) LIMIT 1),
raw AS (SELECT row_id, coalesce(total, t) AS x1, coalesce(balance, bal) AS x2, CAST(signal_label = v AS INTEGER) AS label FROM orders_wide, med, top),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || ':42')) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM raw),
sc AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2,
  covar_samp(x1, x1) + 1e-6 AS ca, covar_samp(x1, x2) AS cb, covar_samp(x2, x2) + 1e-6 AS cc FROM raw),
z AS MATERIALIZED (SELECT row_id, x1, x2, label, r <= CAST(floor(n * 0.2::DOUBLE + 0.5) AS BIGINT) AS is_test,
  (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2,
  (cc * (x1 - m1) * (x1 - m1) - 2 * cb * (x1 - m1) * (x2 - m2) + ca * (x2 - m2) * (x2 - m2)) / (ca * cc - cb * cb) > -2 * ln(0.01::DOUBLE) AS st
  FROM ranked, sc),
{newton_sql('base', 'z', 'NOT is_test', '(SELECT 1 / (s1 * s1) FROM sc)', '(SELECT 1 / (s2 * s2) FROM sc)')},
p AS (SELECT z.*, 1 / (1 + exp(-(w1 * z1 + w2 * z2 + b))) AS p FROM z, base),
g AS (SELECT avg((p - label) * x1) AS g1, avg((p - label) * x2) AS g2 FROM p WHERE is_test),
h AS (SELECT sum(p * (1 - p) * x1 * x1) + 1e-6 AS a, sum(p * (1 - p) * x1 * x2) AS b, sum(p * (1 - p) * x2 * x2) + 1e-6 AS c FROM p WHERE NOT is_test),
infl AS (SELECT p.*, -(p - label) * (x1 * (c * g1 - b * g2) + x2 * (a * g2 - b * g1)) / (a * c - b * b) AS influence FROM p, g, h),
bound AS (SELECT greatest(avg(influence) + stddev_pop(influence), 0) AS bound FROM infl WHERE NOT is_test),
f AS MATERIALIZED (SELECT infl.*, NOT is_test AND influence > bound AS inf FROM infl, bound)"""

def _two_numbers(spark, sf_dir):
    rows = orders_wide(spark, sf_dir).select("row_id", "total", "balance", "signal_label")
    return materialise(rows, "orders")


_F1 = "2.0::DOUBLE * count_if(label = 1 AND {p}) / (count_if(label = 1) + count_if({p}))"


_F1_SQL = f"""
WITH {_AUDIT},
{newton_sql('trim', 'f', 'NOT is_test AND NOT st', '(SELECT 1 / (s1 * s1) FROM sc)', '(SELECT 1 / (s2 * s2) FROM sc)')},
{newton_sql('cut', 'f', 'NOT is_test AND NOT inf', '(SELECT 1 / (s1 * s1) FROM sc)', '(SELECT 1 / (s2 * s2) FROM sc)')},
said AS (SELECT label, base.w1 * z1 + base.w2 * z2 + base.b > 0 AS a, trim.w1 * z1 + trim.w2 * z2 + trim.b > 0 AS s,
  cut.w1 * z1 + cut.w2 * z2 + cut.b > 0 AS i FROM f, base, trim, cut WHERE is_test)
SELECT round({_F1.format(p='a')}, 4) AS f1_orig, round({_F1.format(p='s')}, 4) AS f1_statistic,
  round({_F1.format(p='i')}, 4) AS f1_influence FROM said
"""


@query(_F1_SQL)
def f1_comparison(spark, sf_dir):
    return quality_audit(_two_numbers(spark, sf_dir), "row_id", "signal_label")["f1_report"]


@query(_F1_SQL)
def f1_with_reserved_names(spark, sf_dir):
    """The same audit when the raw columns carry the names the audit itself uses."""
    rows = _two_numbers(spark, sf_dir)
    renamed = rows.select(
        F.col("row_id").alias("is_test"), F.col("total").alias("Label"), F.col("balance").alias("features"),
        F.col("signal_label").alias("prediction"))
    return quality_audit(renamed, "is_test", "prediction")["f1_report"]


@query(f"""
WITH {_AUDIT}
SELECT CAST(count_if(inf) AS BIGINT) AS influence_outliers_count, round(count_if(inf) * 100.0::DOUBLE / count(*), 4) AS influence_outliers_pct,
  CAST(count_if(st) AS BIGINT) AS mahalanobis_outliers_count, round(count_if(st) * 100.0::DOUBLE / count(*), 4) AS mahalanobis_outliers_pct,
  CAST(count_if(inf AND st) AS BIGINT) AS overlap_count FROM f
""")
def audit_outliers(spark, sf_dir):
    fitted = fit_audit(_two_numbers(spark, sf_dir), "row_id", "signal_label", "logistic", "quality")
    return outliers.outlier_summary(flag_outliers(fitted), "infl_outlier", "stat_outlier")


def _audited_orders(spark, sf_dir):
    return materialise(orders_wide(spark, sf_dir).drop("pred", "target", "priority"), "orders")


def _report(found: dict, section_items: dict):
    out = None
    for section, df in found.items():
        rows = tidy(section, df, section_items.get(section))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def quality_report(spark, sf_dir):
    return _report(quality_audit(_audited_orders(spark, sf_dir), "row_id", "signal_label"), {})


@query()
def fairness_report(spark, sf_dir):
    found = fairness_audit(_audited_orders(spark, sf_dir), "row_id", "signal_label")
    return _report(found, {"top_patterns": "pattern", "group_fairness": "sensitive_feature",
                           "precision_by_group": "group", "influence_fairness": "positive_group"})


@query()
def fairness_report_svm(spark, sf_dir):
    found = fairness_audit(_audited_orders(spark, sf_dir), "row_id", "signal_label", "svm")
    return _report(found, {"top_patterns": "pattern", "group_fairness": "sensitive_feature",
                           "precision_by_group": "group", "influence_fairness": "positive_group"})


@query()
def batch_roll_up(spark, sf_dir):
    tables = {
        "orders": lambda: _audited_orders(spark, sf_dir),
        "documents": lambda: materialise(doc_labels(spark, sf_dir).drop("pred", "toxic"), "documents"),
        "events": lambda: events_num(spark, sf_dir).drop("user_id"),
    }
    entries = [
        Entry("orders", "signal_label", platform="sales", row_id="row_id"),
        Entry("documents", "quality", platform="text", row_id="row_id"),
        Entry("events", "event_type", platform="sales", row_id="row_id"),
    ]
    report, _ = batch_audit(spark, entries, load=lambda _, e: tables[e.location]())
    return roll_up(report)
