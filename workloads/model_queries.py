"""Model, influence and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.operators import density, influence, kernel, models, outliers, row_influence, scaling, split
from plumbline.operators.encoding import Design
from plumbline.operators.impute import impute_median
from plumbline.operators.models import LinearModel
from plumbline.session import materialise
from workloads.fixtures import events_num, orders_wide, table
from workloads.registry import query

# Two scaled columns, a label, and the hash split; models with given coefficients, so that
# SQL can follow the same steps.
_EVENT_MODEL = LinearModel("logistic", (0.3, -0.2), -1.4)
_ORDER_MODEL = LinearModel("logistic", (2.0, 0.1), 0.05)
_DESIGN = Design.of_numbers(["x1", "x2"])


def _scaled_events(spark, sf_dir):
    rows = events_num(spark, sf_dir).select(
        "row_id", F.col("value").alias("x1"), F.col("k").alias("x2"),
        (F.col("event_type") == "purchase").cast("int").alias("label"))
    rows = split.hash_split(scaling.standard_scale(rows, ["x1", "x2"]), "row_id")
    return materialise(_DESIGN.with_vector(rows), "scaled_events")


def _scaled_orders(spark, sf_dir):
    rows = orders_wide(spark, sf_dir).select(
        "row_id", F.col("total").alias("x1"), F.col("balance").alias("x2"),
        F.col("signal_label").alias("label"), "race", "nationality", "occupation", "status", "age")
    rows = impute_median(materialise(rows, "orders"), ["x1", "x2"])
    rows = split.hash_split(scaling.standard_scale(rows, ["x1", "x2"]), "row_id")
    return materialise(_DESIGN.with_vector(rows), "scaled_orders")


def _halves(rows):
    return rows.where(~F.col("is_test")), rows.where(F.col("is_test"))


SCALED_EVENTS = """
s AS (SELECT avg(value) AS m1, stddev_pop(value) AS s1, avg(k) AS m2, stddev_pop(k) AS s2 FROM events_num),
d AS (SELECT row_id, (value - m1) / s1 AS x1, (k - m2) / s2 AS x2,
  CAST(event_type = 'purchase' AS INTEGER) AS label,
  substr(md5(CAST(row_id AS VARCHAR) || ':42'), 1, 8) < '33333333' AS is_test FROM events_num, s)"""

SCALED_ORDERS = """
med AS (SELECT quantile_cont(total, 0.5) AS t, quantile_cont(balance, 0.5) AS b FROM orders_wide),
fill AS (SELECT orders_wide.* EXCLUDE (total, balance), coalesce(total, t) AS total, coalesce(balance, b) AS balance FROM orders_wide, med),
s AS (SELECT avg(total) AS m1, stddev_pop(total) AS s1, avg(balance) AS m2, stddev_pop(balance) AS s2 FROM fill),
d AS (SELECT row_id, (total - m1) / s1 AS x1, (balance - m2) / s2 AS x2, signal_label AS label,
  race, nationality, occupation, status, age,
  substr(md5(CAST(row_id AS VARCHAR) || ':42'), 1, 8) < '33333333' AS is_test FROM fill, s)"""


def logistic_influence_sql(w1: float, w2: float, b: float) -> str:
    """CTE ``infl``: training rows with their mean influence, Hessian inverted in closed form."""
    return f"""
p AS (SELECT *, 1 / (1 + exp(-({w1}::DOUBLE * x1 + {w2}::DOUBLE * x2 + {b}::DOUBLE))) AS p FROM d),
g AS (SELECT avg((p - label) * x1) AS g1, avg((p - label) * x2) AS g2 FROM p WHERE is_test),
h AS (SELECT sum(p * (1 - p) * x1 * x1) + 1e-6 AS a, sum(p * (1 - p) * x1 * x2) AS b,
  sum(p * (1 - p) * x2 * x2) + 1e-6 AS c FROM p WHERE NOT is_test),
v AS (SELECT (c * g1 - b * g2) / (a * c - b * b) AS v1, (a * g2 - b * g1) / (a * c - b * b) AS v2 FROM g, h),
infl AS (SELECT p.*, -(p - label) * (x1 * v1 + x2 * v2) AS influence FROM p, v WHERE NOT is_test)"""


@query(f"WITH {SCALED_EVENTS}, {logistic_influence_sql(0.3, -0.2, -1.4)} SELECT row_id, round(influence * 1e6, 4) AS influence_ppm FROM infl")
def influence_logistic(spark, sf_dir):
    train, test = _halves(_scaled_events(spark, sf_dir))
    scored = influence.mean_influence(train, test, _EVENT_MODEL, _DESIGN)
    return scored.select("row_id", F.round(F.col("influence") * 1e6, 4).alias("influence_ppm"))


@query(f"WITH {SCALED_EVENTS}, {logistic_influence_sql(0.3, -0.2, -1.4)} SELECT row_id, round(influence * 1e6, 4) AS influence_ppm FROM infl")
def influence_by_conjugate_gradients(spark, sf_dir):
    train, test = _halves(_scaled_events(spark, sf_dir))
    cfg = AuditConfig(max_dense_features=1)
    scored = influence.mean_influence(train, test, _EVENT_MODEL, _DESIGN, cfg=cfg)
    return scored.select("row_id", F.round(F.col("influence") * 1e6, 4).alias("influence_ppm"))


@query(f"WITH {SCALED_EVENTS}, {logistic_influence_sql(0.3, -0.2, -1.4)} SELECT row_id, round(influence * 1e6, 4) AS influence_ppm FROM infl ORDER BY influence DESC, row_id LIMIT 5")
def top_influential(spark, sf_dir):
    train, test = _halves(_scaled_events(spark, sf_dir))
    best = influence.top_influential(influence.mean_influence(train, test, _EVENT_MODEL, _DESIGN), "row_id", 5)
    return best.select("row_id", F.round(F.col("influence") * 1e6, 4).alias("influence_ppm"))


@query(f"""
WITH {SCALED_EVENTS},
p AS (SELECT *, 1 / (1 + exp(-(0.3::DOUBLE * x1 - 0.2::DOUBLE * x2 - 1.4::DOUBLE))) AS p FROM d),
h AS (SELECT sum(p * (1 - p) * x1 * x1) + 1e-6 AS a, sum(p * (1 - p) * x1 * x2) AS b, sum(p * (1 - p) * x2 * x2) + 1e-6 AS c
  FROM p WHERE NOT is_test),
l AS (SELECT sqrt(a) AS l11, b / sqrt(a) AS l21, sqrt(c - b * b / a) AS l22 FROM h),
w AS (SELECT row_id, is_test, (p - label) * x1 / l11 AS u1, ((p - label) * x2 - l21 * ((p - label) * x1 / l11)) / l22 AS u2 FROM p, l),
scored AS (SELECT t.row_id AS test_id, i.row_id AS train_id, -(t.u1 * i.u1 + t.u2 * i.u2) AS influence
  FROM w t JOIN w i ON t.is_test AND NOT i.is_test)
SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY influence DESC, train_id)::INTEGER AS rank, round(influence * 1e6, 4) AS influence_ppm
FROM scored QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY influence DESC, train_id) <= 5
""")
def influence_per_test_row(spark, sf_dir):
    """The five training rows that raise the loss of each test row most, of all training rows."""
    train, test = _halves(_scaled_events(spark, sf_dir))
    method = influence.influence_of(_EVENT_MODEL, _DESIGN, train)
    found = row_influence.most_influential(train, test, method, "row_id", 5)
    return found.select("test_id", "rank", F.round(F.col("influence") * 1e6, 4).alias("influence_ppm"))


@query(f"""
WITH {SCALED_EVENTS},
p AS (SELECT *, CASE WHEN (2 * label - 1) * (0.3::DOUBLE * x1 - 0.2::DOUBLE * x2 - 0.4::DOUBLE) < 1 THEN -(2 * label - 1) ELSE 0 END AS pull FROM d),
g AS (SELECT avg(pull * x1) AS g1, avg(pull * x2) AS g2 FROM p WHERE is_test)
SELECT row_id, round(-pull * (x1 * g1 + x2 * g2), 6) + 0.0::DOUBLE AS influence FROM p, g WHERE NOT is_test
""")
def influence_svm(spark, sf_dir):
    train, test = _halves(_scaled_events(spark, sf_dir))
    scored = influence.mean_influence(train, test, LinearModel("svm", (0.3, -0.2), -0.4), _DESIGN)
    return scored.select("row_id", (F.round("influence", 6) + F.lit(0.0)).alias("influence"))


_ORDER_INFLUENCE = f"{SCALED_ORDERS}, {logistic_influence_sql(2.0, 0.1, 0.05)}"


def order_influence(spark, sf_dir):
    train, test = _halves(_scaled_orders(spark, sf_dir))
    return influence.mean_influence(train, test, _ORDER_MODEL, _DESIGN)


@query(f"""
WITH {_ORDER_INFLUENCE},
t AS (SELECT greatest(avg(influence) + stddev_pop(influence), 0) AS bound FROM infl)
SELECT row_id, influence > bound AS is_outlier FROM infl, t
""")
def influence_outliers(spark, sf_dir):
    flagged = influence.influence_flags(order_influence(spark, sf_dir), AuditConfig().sigma_multiplier)
    return flagged.select("row_id", "is_outlier")


_MAHALANOBIS = """
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, covar_samp(x1, x1) + 1e-6 AS a, covar_samp(x1, x2) AS b,
  covar_samp(x2, x2) + 1e-6 AS c FROM d),
maha AS (SELECT row_id, (c * (x1 - m1) * (x1 - m1) - 2 * b * (x1 - m1) * (x2 - m2) + a * (x2 - m2) * (x2 - m2))
  / (a * c - b * b) AS d2 FROM d, m)"""


@query(f"WITH {SCALED_EVENTS}, {_MAHALANOBIS} SELECT row_id, round(d2, 6) AS d2, d2 > -2 * ln(0.01::DOUBLE) AS is_outlier FROM maha")
def mahalanobis(spark, sf_dir):
    done = outliers.mahalanobis(_scaled_events(spark, sf_dir), ["x1", "x2"], AuditConfig().alpha)
    return done.select("row_id", F.round("d2", 6).alias("d2"), "is_outlier")


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _cholesky_sql(names: list[str]) -> str:
    """Squared distance by the triangular factor of the covariance, one scalar a line."""
    d = len(names)
    cov = ", ".join(f"covar_samp({names[i]}, {names[j]}){' + 1e-6::DOUBLE' if i == j else ''} AS c{i}{j}" for i in range(d) for j in range(i + 1))
    means = ", ".join(f"avg({n}) AS m{i}" for i, n in enumerate(names))
    steps, last = [f"k AS (SELECT {cov}, {means} FROM t)"], "k"
    for j in range(d):
        for i in range(j, d):
            done = " ".join(f"- l{i}{q} * l{j}{q}" for q in range(j))
            value = f"sqrt(c{j}{j} {done})" if i == j else f"(c{i}{j} {done}) / l{j}{j}"
            steps.append(f"k{i}{j} AS (SELECT *, {value} AS l{i}{j} FROM {last})")
            last = f"k{i}{j}"
    steps.append(f"y0 AS (SELECT t.*, {last}.*, ({names[0]} - m0) / l00 AS z0 FROM t, {last})")
    for i in range(1, d):
        done = " ".join(f"- l{i}{q} * z{q}" for q in range(i))
        steps.append(f"y{i} AS (SELECT *, ({names[i]} - m{i} {done}) / l{i}{i} AS z{i} FROM y{i - 1})")
    return ", ".join(steps) + f", dist AS (SELECT *, {' + '.join(f'z{i} * z{i}' for i in range(d))} AS d2 FROM y{d - 1})"


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _WIDE)} FROM lineitem), {_cholesky_sql(_WIDE)}
SELECT l_orderkey, l_linenumber, round(d2, 5) AS d2 FROM dist
""")
def mahalanobis_four_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_WIDE)
    return outliers.mahalanobis(rows, _WIDE).select("l_orderkey", "l_linenumber", F.round("d2", 5).alias("d2"))


@query(f"WITH {SCALED_EVENTS}, {_MAHALANOBIS} SELECT row_id FROM maha WHERE NOT d2 > -2 * ln(0.01::DOUBLE)")
def drop_statistic_outliers(spark, sf_dir):
    done = outliers.mahalanobis(_scaled_events(spark, sf_dir), ["x1", "x2"], AuditConfig().alpha)
    return outliers.drop_flagged(done, "is_outlier").select("row_id")


@query(f"""
WITH {_ORDER_INFLUENCE}, t AS (SELECT greatest(avg(influence) + stddev_pop(influence), 0) AS bound FROM infl)
SELECT row_id FROM d WHERE row_id NOT IN (SELECT row_id FROM infl, t WHERE influence > bound)
""")
def drop_influence_outliers(spark, sf_dir):
    rows = _scaled_orders(spark, sf_dir)
    train, test = _halves(rows)
    flagged = influence.influence_flags(influence.mean_influence(train, test, _ORDER_MODEL, _DESIGN), 1.0)
    return outliers.drop_listed(rows.select("row_id"), flagged.where("is_outlier"), "row_id")


_NOISE = """
near AS (SELECT a.row_id, count(*) >= 5 AS core FROM d a JOIN d b
  ON (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= 0.25::DOUBLE GROUP BY a.row_id),
cores AS (SELECT d.* FROM d JOIN near ON d.row_id = near.row_id WHERE core),
noise AS (SELECT near.row_id, core, NOT core AND NOT EXISTS (SELECT 1 FROM d a, cores b WHERE a.row_id = near.row_id
  AND (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= 0.25::DOUBLE) AS is_outlier FROM near)"""


@query(f"WITH {SCALED_EVENTS}, {_NOISE} SELECT row_id, core AS is_core, is_outlier FROM noise")
def dbscan_noise(spark, sf_dir):
    rows = events_num(spark, sf_dir).select("row_id", "value", "k")
    return density.density_noise(rows, "row_id", ["value", "k"])


_DENSITY_COLUMNS = ["p_size", "p_retailprice", "p_name_length", "p_key_rest"]


def _part_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("p_name_length"),
        (F.col("p_partkey") % 7).alias("p_key_rest"))


def _noise_sql(names: list[str], eps: str) -> str:
    """Noise by comparing all pairs of parts on standardised columns."""
    facts = ", ".join(f"avg({n}) AS m{i}, stddev_pop({n}) AS s{i}" for i, n in enumerate(names))
    # A constant column is divided by one, as in the scaling operator.
    z = ", ".join(f"({n} - m{i}) / (CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END) AS x{i}" for i, n in enumerate(names))
    near = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(names))) + f" <= {eps}::DOUBLE"
    return f"""
WITH n AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice, length(p_name)::DOUBLE AS p_name_length, (p_partkey % 7)::DOUBLE AS p_key_rest FROM part),
s AS (SELECT {facts} FROM n), d AS MATERIALIZED (SELECT p_partkey, {z} FROM n, s),
near AS MATERIALIZED (SELECT a.p_partkey, count(*) >= 5 AS core FROM d a JOIN d b ON {near} GROUP BY a.p_partkey),
cores AS (SELECT d.* FROM d JOIN near USING (p_partkey) WHERE core),
touched AS (SELECT DISTINCT a.p_partkey FROM d a JOIN cores b ON {near})
SELECT near.p_partkey AS row_id, core AS is_core, NOT core AND touched.p_partkey IS NULL AS is_outlier FROM near LEFT JOIN touched USING (p_partkey)"""


@query(_noise_sql(_DENSITY_COLUMNS[:3], "0.25"))
def dbscan_noise_three_columns(spark, sf_dir):
    return density.density_noise(_part_numbers(spark, sf_dir), "p_partkey", _DENSITY_COLUMNS[:3])


@query(_noise_sql(_DENSITY_COLUMNS, "0.25"))
def dbscan_noise_four_columns(spark, sf_dir):
    return density.density_noise(_part_numbers(spark, sf_dir), "p_partkey", _DENSITY_COLUMNS)


@query(f"""
WITH {SCALED_EVENTS}, {_MAHALANOBIS}, {logistic_influence_sql(0.3, -0.2, -1.4)},
t AS (SELECT greatest(avg(influence) + stddev_pop(influence), 0) AS bound FROM infl),
f AS (SELECT maha.row_id, d2 > -2 * ln(0.01::DOUBLE) AS st, coalesce(influence > bound, FALSE) AS inf
  FROM maha LEFT JOIN infl ON maha.row_id = infl.row_id, t)
SELECT CAST(count_if(inf) AS BIGINT) AS influence_outliers_count, round(count_if(inf) * 100.0::DOUBLE / count(*), 4) AS influence_outliers_pct,
  CAST(count_if(st) AS BIGINT) AS mahalanobis_outliers_count, round(count_if(st) * 100.0::DOUBLE / count(*), 4) AS mahalanobis_outliers_pct,
  CAST(count_if(inf AND st) AS BIGINT) AS overlap_count FROM f
""")
def outlier_summary(spark, sf_dir):
    rows = _scaled_events(spark, sf_dir)
    train, test = _halves(rows)
    score = influence.influence_score(train, test, _EVENT_MODEL, _DESIGN)
    bound = influence.influence_bound(train.select(score.alias("influence")), 1.0)
    marked = outliers.mahalanobis(rows, ["x1", "x2"]).withColumn("infl", ~F.col("is_test") & (score > bound))
    return outliers.outlier_summary(marked, "infl", "is_outlier")


@query(f"""
WITH {SCALED_EVENTS}, {_MAHALANOBIS}, {_NOISE}, {logistic_influence_sql(0.3, -0.2, -1.4)},
t AS (SELECT greatest(avg(influence) + stddev_pop(influence), 0) AS bound FROM infl),
f AS (SELECT maha.row_id, d2 > -2 * ln(0.01::DOUBLE) AS m, noise.is_outlier AS b, coalesce(influence > bound, FALSE) AS i
  FROM maha JOIN noise ON maha.row_id = noise.row_id LEFT JOIN infl ON maha.row_id = infl.row_id, t)
SELECT unnest(['Mahalanobis', 'DBSCAN', 'Influence', 'Mahalanobis & DBSCAN', 'Mahalanobis & Influence',
    'DBSCAN & Influence', 'Mahalanobis & DBSCAN & Influence']) AS methods,
  unnest([count_if(m), count_if(b), count_if(i), count_if(m AND b), count_if(m AND i), count_if(b AND i),
    count_if(m AND b AND i)])::BIGINT AS rows FROM f
""")
def outlier_overlap(spark, sf_dir):
    rows = _scaled_events(spark, sf_dir)
    train, test = _halves(rows)
    flagged = influence.influence_flags(influence.mean_influence(train, test, _EVENT_MODEL, _DESIGN), 1.0)
    flags = {
        "Mahalanobis": outliers.mahalanobis(rows, ["x1", "x2"]),
        "DBSCAN": density.density_noise(rows, "row_id", ["x1", "x2"]),
        "Influence": flagged,
    }
    return outliers.overlap_table(outliers.attach_flags(rows.select("row_id"), "row_id", flags), list(flags))


@query("""
WITH c AS (SELECT count_if(signal_label = 1 AND pred = 1) AS tp, count_if(pred = 1) AS said, count_if(signal_label = 1) AS real FROM orders_wide)
SELECT round(2.0::DOUBLE * tp / (said + real), 6) AS f1 FROM c
""")
def f1(spark, sf_dir):
    return models.f1_score(orders_wide(spark, sf_dir), "signal_label", "pred").select(F.round("f1", 6).alias("f1"))


@query("""
WITH r AS (SELECT l_linenumber % 3 AS y, CAST(l_quantity AS INTEGER) % 3 AS p FROM lineitem),
per AS (SELECT cls, count_if(y = cls) AS real, 2.0::DOUBLE * count_if(y = cls AND p = cls) / nullif(count_if(y = cls) + count_if(p = cls), 0) AS f
  FROM r, (SELECT unnest([0, 1, 2]) AS cls) GROUP BY cls)
SELECT round(sum(coalesce(f, 0) * real) / sum(real), 6) AS f1 FROM per
""")
def f1_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("y"), (F.col("l_quantity").cast("int") % 3).alias("p"))
    return models.f1_score(rows, "y", "p").select(F.round("f1", 6).alias("f1"))


# Components of the kernel matrix by power iteration, one after the other, over the different points and their counts.
_POWER_STEPS = 30


def _kernel_sql(components: int) -> str:
    steps = ["""
q AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem),
m AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2 FROM q),
points AS MATERIALIZED (SELECT l_quantity AS a, l_discount AS b, any_value((l_quantity - m1) / s1) AS x, any_value((l_discount - m2) / s2 / 4) AS y,
  count(*)::DOUBLE AS w FROM q, m GROUP BY l_quantity, l_discount),
n AS (SELECT sum(w) AS n FROM points),
raw AS MATERIALIZED (SELECT p.a, p.b, q.a AS qa, q.b AS qb, q.w, exp(-0.5 * ((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS k FROM points p, points q),
means AS MATERIALIZED (SELECT a, b, sum(k * w) / any_value(n) AS r FROM raw, n GROUP BY a, b),
whole AS (SELECT sum(r * w) / any_value(n) AS s FROM means JOIN points USING (a, b), n),
k0 AS MATERIALIZED (SELECT raw.a, raw.b, qa, qb, w, k - p.r - q.r + s AS k FROM raw JOIN means p ON raw.a = p.a AND raw.b = p.b
  JOIN means q ON qa = q.a AND qb = q.b, whole)"""]
    for j in range(components):
        steps.append(f"f{j}_0 AS MATERIALIZED (SELECT a, b, x + 0.6 * y + 0.3 * x * x + 0.2 * x * y + 0.1 AS f FROM points)")
        for i in range(_POWER_STEPS):
            steps.append(f"""
g{j}_{i} AS (SELECT k.a, k.b, sum(k * w * f) / any_value(n) AS f FROM k{j} k JOIN f{j}_{i} f ON qa = f.a AND qb = f.b, n GROUP BY k.a, k.b),
l{j}_{i} AS (SELECT sqrt(sum(f * f * w) / any_value(n)) AS l FROM g{j}_{i} JOIN points USING (a, b), n),
f{j}_{i + 1} AS MATERIALIZED (SELECT a, b, f / l AS f FROM g{j}_{i}, l{j}_{i})""")
        last = f"f{j}_{_POWER_STEPS}"
        steps.append(f"l{j} AS (SELECT l FROM l{j}_{_POWER_STEPS - 1})")
        steps.append(f"""
k{j + 1} AS MATERIALIZED (SELECT k.a, k.b, qa, qb, w, k - l * p.f * q.f AS k FROM k{j} k JOIN {last} p ON k.a = p.a AND k.b = p.b
  JOIN {last} q ON qa = q.a AND qb = q.b, l{j})""")
    return ",".join(steps)


def _scaled_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").withColumn("row_id", F.monotonically_increasing_id())
    rows = scaling.standard_scale(rows.withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount")}), ["x", "y"])
    return materialise(rows.withColumn("y", F.col("y") / 4), "scaled-lines")


@query(f"WITH {_kernel_sql(2)} SELECT 1 AS component, round(l, 6) AS variance, true AS certified FROM l0 UNION ALL SELECT 2, round(l, 6), true FROM l1")
def kernel_pca_components(spark, sf_dir):
    """Variances along the first two components, with a certified error below 1e-7."""
    found = kernel.kernel_components(_scaled_lines(spark, sf_dir), "row_id", ["x", "y"], components=2)
    return found.select("component", F.round("variance", 6).alias("variance"), (F.col("error") < 1e-7).alias("certified"))


@query(f"""
WITH {_kernel_sql(2)}, scores AS (SELECT a, b, round(k, 6) AS score FROM k2 WHERE a = qa AND b = qb)
SELECT l_orderkey, l_linenumber, score + 0.0::DOUBLE AS score FROM q JOIN scores ON l_quantity = a AND l_discount = b
""")
def kernel_pca_scores(spark, sf_dir):
    """Every row's distance from what two components rebuild, by the kernel itself."""
    rows = _scaled_lines(spark, sf_dir)
    scored = kernel.kernel_pca_outliers(rows, "row_id", ["x", "y"], components=2)
    return rows.join(scored, "row_id").select("l_orderkey", "l_linenumber", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query()
def kernel_pca(spark, sf_dir):
    rows = scaling.standard_scale(events_num(spark, sf_dir).select("row_id", "value", "k"), ["value", "k"])
    return kernel.kernel_pca_outliers(rows, "row_id", ["value", "k"])
