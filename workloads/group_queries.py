"""Pattern and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import fairness, patterns
from workloads.fixtures import doc_labels, orders_wide
from workloads.model_queries import _ORDER_INFLUENCE, order_influence
from workloads.registry import query

_MINED = ["race", "nationality", "occupation", "status", "age"]
_THIRDS = """
e AS (SELECT quantile_cont(age, 1.0::DOUBLE / 3) AS e1, quantile_cont(age, 2.0::DOUBLE / 3) AS e2, CAST(min(age) AS DOUBLE) AS lo, CAST(max(age) AS DOUBLE) AS hi FROM infl),
f AS (SELECT infl.*, CASE
    WHEN age > e2 THEN printf('(%.1f, %.1f]', e2, hi)
    WHEN age > e1 THEN printf('(%.1f, %.1f]', e1, e2)
    ELSE printf('[%.1f, %.1f]', lo, e1) END AS age_third FROM infl, e),
items AS (
  SELECT row_id, influence, 'race' AS col, race AS val FROM f
  UNION ALL SELECT row_id, influence, 'nationality', nationality FROM f
  UNION ALL SELECT row_id, influence, 'occupation', occupation FROM f
  UNION ALL SELECT row_id, influence, 'status', status FROM f
  UNION ALL SELECT row_id, influence, 'age', age_third FROM f),
total AS (SELECT count(*) AS n, sum(influence) AS s FROM infl),
singles AS (SELECT col, val, count(*) AS n, sum(influence) AS s FROM items GROUP BY ALL)"""
_SCORES = """round(a.n * 1.0::DOUBLE / t.n, 4) AS support, round(a.s / abs(t.s), 4) AS responsibility,
  round((a.s / abs(t.s)) / (a.n * 1.0::DOUBLE / t.n), 4) AS interestingness"""


def _mined(spark, sf_dir):
    return order_influence(spark, sf_dir).select(*_MINED, "influence")


@query(f"""
WITH {_ORDER_INFLUENCE}, {_THIRDS}
SELECT a.col, a.val, a.n, round(a.s / abs(t.s), 4) AS responsibility FROM singles a, total t
""")
def single_patterns(spark, sf_dir):
    rows = _mined(spark, sf_dir)
    total = rows.agg(F.sum("influence").alias("s")).first().s
    found = patterns.single_patterns(rows, patterns.pattern_items(rows, []))
    return found.select("col", "val", "n", F.round(F.col("influence_sum") / abs(total), 4).alias("responsibility"))


@query(f"""
WITH {_ORDER_INFLUENCE}, {_THIRDS}
SELECT col AS pattern_col_1, val AS pattern_val_1, CAST(NULL AS VARCHAR) AS pattern_col_2, CAST(NULL AS VARCHAR) AS pattern_val_2,
  col || ' = ' || val AS pattern, {_SCORES}
FROM singles a, total t WHERE a.n >= 0.05::DOUBLE * t.n ORDER BY interestingness DESC, pattern LIMIT 5
""")
def top_patterns(spark, sf_dir):
    return patterns.top_patterns(_mined(spark, sf_dir), [], min_support=0.05, top_k=5)


_ORDER = "CASE {} WHEN 'race' THEN 0 WHEN 'nationality' THEN 1 WHEN 'occupation' THEN 2 WHEN 'status' THEN 3 ELSE 4 END"


@query(f"""
WITH {_ORDER_INFLUENCE}, {_THIRDS},
pairs AS (SELECT x.col AS c1, x.val AS v1, y.col AS c2, y.val AS v2, count(*) AS n, sum(x.influence) AS s
  FROM items x JOIN items y ON x.row_id = y.row_id AND {_ORDER.format('x.col')} < {_ORDER.format('y.col')} GROUP BY ALL),
both_ AS (SELECT col AS c1, val AS v1, CAST(NULL AS VARCHAR) AS c2, CAST(NULL AS VARCHAR) AS v2, n, s, col || ' = ' || val AS pattern FROM singles
  UNION ALL SELECT c1, v1, c2, v2, n, s, c1 || ' = ' || v1 || ' AND ' || c2 || ' = ' || v2 FROM pairs)
SELECT c1 AS pattern_col_1, v1 AS pattern_val_1, c2 AS pattern_col_2, v2 AS pattern_val_2, pattern, {_SCORES}
FROM both_ a, total t WHERE a.n >= 0.02::DOUBLE * t.n
""")
def pair_patterns(spark, sf_dir):
    return patterns.top_patterns(_mined(spark, sf_dir), [], min_support=0.02, top_k=None, max_predicates=2)


@query(f"""
WITH {_ORDER_INFLUENCE}, {_THIRDS},
triples AS (SELECT x.col || ' = ' || x.val || ' AND ' || y.col || ' = ' || y.val || ' AND ' || z.col || ' = ' || z.val AS pattern,
  count(*) AS n, sum(x.influence) AS s FROM items x
  JOIN items y ON x.row_id = y.row_id AND {_ORDER.format('x.col')} < {_ORDER.format('y.col')}
  JOIN items z ON x.row_id = z.row_id AND {_ORDER.format('y.col')} < {_ORDER.format('z.col')} GROUP BY 1)
SELECT pattern, {_SCORES} FROM triples a, total t WHERE a.n >= 0.01::DOUBLE * t.n
""")
def triple_patterns(spark, sf_dir):
    found = patterns.top_patterns(_mined(spark, sf_dir), [], min_support=0.01, top_k=None, max_predicates=3)
    three = F.size(F.split("pattern", " AND ")) == 3
    return found.where(three).select("pattern", "support", "responsibility", "interestingness")


@query(f"""
WITH {_ORDER_INFLUENCE}, total AS (SELECT count(*) AS n, sum(influence) AS s FROM infl),
m AS (SELECT count(*) AS n, sum(influence) AS s FROM infl WHERE race = 'ASIA' AND age > 40 AND age <= 60)
SELECT 'race = ASIA AND age = (40, 60]' AS pattern, round(m.n * 1.0::DOUBLE / total.n, 6) AS support,
  round(m.s / total.s, 6) AS responsibility, round(m.s / total.s / (m.n * 1.0::DOUBLE / total.n), 6) AS interestingness FROM m, total
""")
def score_pattern(spark, sf_dir):
    one = patterns.score_pattern(_mined(spark, sf_dir), {"race": "ASIA", "age": "(40, 60]"})
    return one.select("pattern", *[F.round(n, 6).alias(n) for n in ("support", "responsibility", "interestingness")])


_EFFECT = """
  round(m1 * 1e6, 4) AS mean_positive_ppm, round(m2 * 1e6, 4) AS mean_other_ppm,
  round(CASE WHEN pooled > 0 THEN (m1 - m2) / pooled ELSE 0 END, 6) AS cohen_d,
  coalesce(abs((m1 - m2) / m2) <= 3, FALSE) AS inf_fair,
  coalesce(abs(CASE WHEN pooled > 0 THEN (m1 - m2) / pooled ELSE 0 END) <= 0.2::DOUBLE, FALSE) AS cohen_fair"""


def _effect_row(name: str, value: str, mask: str) -> str:
    return f"""SELECT '{name}' AS group_col, '{value}' AS positive_group,
  avg(influence) FILTER ({mask}) AS m1, avg(influence) FILTER (NOT ({mask})) AS m2,
  sqrt(((count(*) FILTER ({mask}) - 1) * var_samp(influence) FILTER ({mask})
    + (count(*) FILTER (NOT ({mask})) - 1) * var_samp(influence) FILTER (NOT ({mask}))) / (count(*) - 2)) AS pooled FROM infl"""


def _shown(effects):
    return effects.select(
        "group_col", "positive_group", F.round(F.col("mean_positive_group") * 1e6, 4).alias("mean_positive_ppm"),
        F.round(F.col("mean_other") * 1e6, 4).alias("mean_other_ppm"), F.round("cohen_d", 6).alias("cohen_d"),
        "inf_fair", "cohen_fair")


@query(f"""
WITH {_ORDER_INFLUENCE}, picked AS ({_effect_row('race', 'ASIA', "race = 'ASIA'")}
  UNION ALL {_effect_row('age', '[18, 30)', 'age >= 18 AND age < 30')}
  UNION ALL {_effect_row('nationality', 'NATION_7', "nationality = 'NATION_7'")})
SELECT group_col, positive_group, {_EFFECT} FROM picked
""")
def cohens_d(spark, sf_dir):
    groups = [("race", "ASIA"), ("age", "[18, 30)"), ("nationality", "NATION_7")]
    return _shown(fairness.influence_effects(_mined(spark, sf_dir), groups))


@query(f"""
WITH {_ORDER_INFLUENCE},
long AS (SELECT 'race' AS f, race AS g, influence AS x FROM infl UNION ALL SELECT 'occupation', occupation, influence FROM infl
  UNION ALL SELECT 'nationality', nationality, influence FROM infl),
inside AS (SELECT f, g, count(*) AS n1, avg(x) AS m1, coalesce(var_samp(x), 0) AS v1 FROM long GROUP BY ALL),
other AS (SELECT a.f, a.g, count(*) AS n2, avg(b.x) AS m2, var_samp(b.x) AS v2 FROM inside a JOIN long b ON a.f = b.f AND a.g <> b.g GROUP BY ALL),
both_ AS (SELECT inside.f AS group_col, inside.g AS positive_group, m1, m2,
  sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS pooled FROM inside JOIN other ON inside.f = other.f AND inside.g = other.g)
SELECT group_col, positive_group, {_EFFECT} FROM both_
""")
def cohens_d_by_value(spark, sf_dir):
    rows = _mined(spark, sf_dir)
    return _shown(fairness.influence_effects_by_value(rows, ["race", "occupation", "nationality"]))


def _confusion(view: str, label: str, columns: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, coalesce(CAST({n} AS VARCHAR), 'nan') AS grp, {label} AS y, pred AS p FROM {view}" for n in columns)
    return f"""long AS ({long}),
conf AS (SELECT feature, grp, count(*) AS n, CAST(sum(p) AS BIGINT) AS predicted,
  CAST(count_if(y = 1 AND p = 1) AS BIGINT) AS tp, CAST(count_if(y = 0 AND p = 1) AS BIGINT) AS fp,
  CAST(count_if(y = 1 AND p = 0) AS BIGINT) AS fn, CAST(count_if(y = 0 AND p = 0) AS BIGINT) AS tn FROM long GROUP BY ALL),
rates AS (SELECT *, predicted * 1.0::DOUBLE / n AS sel, coalesce(tp * 1.0::DOUBLE / nullif(tp + fn, 0), 0) AS tpr,
  coalesce(fp * 1.0::DOUBLE / nullif(fp + tn, 0), 0) AS fpr, coalesce(tp * 1.0::DOUBLE / nullif(predicted, 0), 0) AS ppv FROM conf),
gaps AS (SELECT feature, max(sel) - min(sel) AS dpd, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eod,
  max(ppv) - min(ppv) AS ppvd, max(ppv) AS best FROM rates GROUP BY 1)"""


_FAIR = """
SELECT feature AS sensitive_feature, round(dpd, 6) AS DPD, dpd <= 0.1::DOUBLE AS DPD_fair, round(eod, 6) AS EOD,
  eod <= 0.1::DOUBLE AS EOD_fair, round(ppvd, 6) AS PPV_diff, ppvd <= 0.1::DOUBLE AS PPV_fair FROM gaps"""
_ORDER_GROUPS = ["race", "nationality", "occupation", "age"]
_DOC_GROUPS = ["lang", "source"]


def _records(records):
    return records.select(
        "sensitive_feature", F.round("DPD", 6).alias("DPD"), "DPD_fair", F.round("EOD", 6).alias("EOD"),
        "EOD_fair", F.round("PPV_diff", 6).alias("PPV_diff"), "PPV_fair")


@query(f"WITH {_confusion('orders_wide', 'signal_label', _ORDER_GROUPS)} {_FAIR}")
def fairness_classical(spark, sf_dir):
    return _records(fairness.fairness_records(orders_wide(spark, sf_dir), _ORDER_GROUPS, "signal_label", "pred"))


@query(f"WITH {_confusion('doc_labels', 'quality', _DOC_GROUPS)} {_FAIR}")
def fairness_documents(spark, sf_dir):
    return _records(fairness.fairness_records(doc_labels(spark, sf_dir), _DOC_GROUPS, "quality", "pred"))


@query(f"WITH {_confusion('orders_wide', 'signal_label', _ORDER_GROUPS)} SELECT feature, grp, n, predicted, tp, fp, fn, tn FROM conf")
def group_confusion(spark, sf_dir):
    return fairness.group_confusion(orders_wide(spark, sf_dir), _ORDER_GROUPS, "signal_label", "pred")


@query(f"WITH {_confusion('orders_wide', 'signal_label', _ORDER_GROUPS)} SELECT feature, round(dpd, 6) AS DPD FROM gaps")
def demographic_parity(spark, sf_dir):
    gaps = fairness.demographic_parity(orders_wide(spark, sf_dir), _ORDER_GROUPS, "pred")
    return gaps.select("feature", F.round("DPD", 6).alias("DPD"))


@query(f"WITH {_confusion('orders_wide', 'signal_label', _ORDER_GROUPS)} SELECT feature, round(eod, 6) AS EOD FROM gaps")
def equalised_odds(spark, sf_dir):
    gaps = fairness.equalised_odds(orders_wide(spark, sf_dir), _ORDER_GROUPS, "signal_label", "pred")
    return gaps.select("feature", F.round("EOD", 6).alias("EOD"))


@query(f"""WITH {_confusion('orders_wide', 'signal_label', _ORDER_GROUPS)}
SELECT feature, grp, round(ppv, 6) AS ppv, round(best - ppv, 6) AS gap, best - ppv <= 0.1::DOUBLE AS fair FROM rates JOIN gaps USING (feature)""")
def predictive_parity(spark, sf_dir):
    rows = fairness.predictive_parity(orders_wide(spark, sf_dir), _ORDER_GROUPS, "signal_label", "pred")
    return rows.select("feature", "grp", F.round("ppv", 6).alias("ppv"), F.round("gap", 6).alias("gap"), "fair")


@query("""
SELECT race AS grp, round(avg(CAST(pred = signal_label AS INTEGER)), 6) AS accuracy, round(avg(total), 4) AS mean_total, count(*) AS n
FROM orders_wide GROUP BY 1
""")
def group_metric(spark, sf_dir):
    rows = orders_wide(spark, sf_dir)
    return fairness.group_metric(
        rows, "race", accuracy=F.round(F.avg((F.col("pred") == F.col("signal_label")).cast("int")), 6),
        mean_total=F.round(F.avg("total"), 4), n=F.count(F.lit(1)))
