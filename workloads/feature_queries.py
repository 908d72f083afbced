"""Feature preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.missing import normalise_missing
from plumbline.operators import binning, encoding, impute, knn, scaling, split, target, text
from plumbline.operators.profile import collect_roles
from plumbline.operators.quantiles import number
from plumbline.plans import features
from plumbline.plans.features import encode_sensitive, one_hot_standardised
from plumbline.session import materialise
from workloads.fixtures import events_num, orders_wide, table
from workloads.registry import query


def _clean_orders(spark, sf_dir, *columns):
    return materialise(normalise_missing(orders_wide(spark, sf_dir).select(*columns)), "clean-orders")


def _clean(n: str) -> str:
    return f"CASE WHEN trim({n}) <> '' AND {n} NOT IN ('?', 'NA', 'N/A') THEN {n} END"


@query("""
SELECT row_id, round(coalesce(total, (SELECT quantile_cont(total, 0.5) FROM orders_wide)), 4) AS total,
  round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM orders_wide)), 4) AS balance FROM orders_wide
""")
def impute_median(spark, sf_dir):
    rows = orders_wide(spark, sf_dir).select("row_id", "total", "balance")
    filled = impute.impute_median(rows, ["total", "balance"])
    return filled.select("row_id", F.round("total", 4).alias("total"), F.round("balance", 4).alias("balance"))


def _mode(n: str) -> str:
    return (f"(SELECT v FROM (SELECT {_clean(n)} AS v, count(*) AS k FROM orders_wide GROUP BY 1) "
            "WHERE v IS NOT NULL ORDER BY k DESC, v LIMIT 1)")


@query(f"""
SELECT row_id, coalesce({_clean('status')}, {_mode('status')}) AS status,
  coalesce({_clean('priority')}, {_mode('priority')}) AS priority FROM orders_wide
""")
def impute_mode(spark, sf_dir):
    return impute.impute_mode(_clean_orders(spark, sf_dir, "row_id", "status", "priority"), ["status", "priority"])


@query(f"""
SELECT row_id, coalesce({_clean('status')}, '<MISSING>') AS status,
  coalesce({_clean('priority')}, '<MISSING>') AS priority FROM orders_wide
""")
def impute_placeholder(spark, sf_dir):
    rows = _clean_orders(spark, sf_dir, "row_id", "status", "priority")
    return impute.impute_placeholder(rows, ["status", "priority"])


@query("""
SELECT row_id, round(coalesce(total, (SELECT avg(total) FROM orders_wide)), 4) AS total FROM orders_wide
""")
def impute_neighbours(spark, sf_dir):
    rows = orders_wide(spark, sf_dir).select("row_id", "total")
    return impute.impute_neighbours_single(rows, "total").select("row_id", F.round("total", 4).alias("total"))


def _gappy_orders(spark, sf_dir):
    return orders_wide(spark, sf_dir).select(
        "row_id", "total", "balance", F.when(F.col("row_id") % 13 != 0, F.col("age").cast("double")).alias("age"))


def _all_pairs_fill(column: str) -> str:
    return f"""
{column}_near AS (
  SELECT row_id, value, dist FROM (SELECT row_id, donor, donor_{column} AS value, dist FROM pairs WHERE {column} IS NULL)
  WHERE value IS NOT NULL AND dist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, donor) <= 5),
{column}_fill AS (
  SELECT row_id, CASE WHEN min(dist) = 0 THEN avg(value) FILTER (dist = 0) ELSE
    sum(value / sqrt(dist)) FILTER (dist > 0) / sum(1 / sqrt(dist)) FILTER (dist > 0) END AS value FROM {column}_near GROUP BY row_id)"""


@query(f"""
WITH r AS (SELECT row_id, total, balance, CASE WHEN row_id % 13 <> 0 THEN age::DOUBLE END AS age FROM orders_wide),
pairs AS (
  SELECT g.*, d.row_id AS donor, d.total AS donor_total, d.balance AS donor_balance, d.age AS donor_age,
    (coalesce((g.total - d.total) * (g.total - d.total), 0) + coalesce((g.balance - d.balance) * (g.balance - d.balance), 0)
      + coalesce((g.age - d.age) * (g.age - d.age), 0)) / nullif(((g.total - d.total) IS NOT NULL)::INT
      + ((g.balance - d.balance) IS NOT NULL)::INT + ((g.age - d.age) IS NOT NULL)::INT, 0) AS dist
  FROM r g JOIN r d ON g.total IS NULL OR g.balance IS NULL OR g.age IS NULL),
{",".join(_all_pairs_fill(n) for n in ("total", "balance", "age"))},
means AS (SELECT avg(total) AS total, avg(balance) AS balance, avg(age) AS age FROM r)
SELECT r.row_id, round(coalesce(r.total, t.value, means.total), 4) AS total, round(coalesce(r.balance, b.value, means.balance), 4) AS balance,
  round(coalesce(r.age, a.value, means.age), 4) AS age
FROM r LEFT JOIN total_fill t USING (row_id) LEFT JOIN balance_fill b USING (row_id) LEFT JOIN age_fill a USING (row_id), means
""")
def knn_fill(spark, sf_dir):
    """Gaps of three columns from the five nearest rows, with every row as a possible donor."""
    names = ["total", "balance", "age"]
    filled = knn.knn_fill(_gappy_orders(spark, sf_dir), names, "row_id")
    return filled.select("row_id", *[F.round(n, 4).alias(n) for n in names])


@query("""
WITH ranked AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r,
    count(*) OVER () AS n FROM lineitem),
b AS (SELECT max(CASE WHEN r = CAST(floor(0.01::DOUBLE * n) AS BIGINT) THEN x END) AS lo,
  max(CASE WHEN r = n - 1 - CAST(floor(0.01::DOUBLE * n) AS BIGINT) THEN x END) AS hi FROM ranked)
SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, lo), hi) AS l_extendedprice FROM lineitem, b
""")
def winsorise(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return scaling.winsorise(rows, ["l_extendedprice"])


@query("""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
SELECT l_orderkey, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax FROM lineitem, s
""")
def standard_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    done = scaling.standard_scale(rows, ["l_quantity", "l_tax"])
    return done.select("l_orderkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


_STATUS = ["<MISSING>", "F", "O", "P"]
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "<MISSING>"]


def _flags(n: str, levels: list[str], wrap=lambda e, a: f'{e} AS "{a}"') -> str:
    return ", ".join(
        wrap(f"CAST(coalesce({_clean(n)}, '<MISSING>') = '{v}' AS INTEGER)", f"{n}_{v}") for v in levels)


@query(f"SELECT row_id, {_flags('status', _STATUS)}, {_flags('priority', _PRIORITY)} FROM orders_wide")
def one_hot(spark, sf_dir):
    rows = _clean_orders(spark, sf_dir, "row_id", "status", "priority")
    return encoding.one_hot(impute.impute_placeholder(rows, ["status", "priority"]), ["status", "priority"])


@query(f"SELECT row_id, {_flags('status', _STATUS[1:])}, {_flags('priority', _PRIORITY[1:])} FROM orders_wide")
def one_hot_drop_first(spark, sf_dir):
    rows = _clean_orders(spark, sf_dir, "row_id", "status", "priority")
    filled = impute.impute_placeholder(rows, ["status", "priority"])
    return encoding.one_hot(filled, ["status", "priority"], drop_first=True)


@query("""
WITH w AS (
  SELECT value, CAST(event_type = 'click' AS INTEGER) AS a, CAST(event_type = 'error' AS INTEGER) AS b,
    CAST(event_type = 'purchase' AS INTEGER) AS c, CAST(event_type = 'signup' AS INTEGER) AS d,
    CAST(event_type = 'view' AS INTEGER) AS e FROM events_num)
SELECT round((value - (SELECT avg(value) FROM w)) / (SELECT stddev_pop(value) FROM w), 6) AS value,
  round((a - (SELECT avg(a) FROM w)) / (SELECT stddev_pop(a) FROM w), 6) AS event_type_click,
  round((b - (SELECT avg(b) FROM w)) / (SELECT stddev_pop(b) FROM w), 6) AS event_type_error,
  round((c - (SELECT avg(c) FROM w)) / (SELECT stddev_pop(c) FROM w), 6) AS event_type_purchase,
  round((d - (SELECT avg(d) FROM w)) / (SELECT stddev_pop(d) FROM w), 6) AS event_type_signup,
  round((e - (SELECT avg(e) FROM w)) / (SELECT stddev_pop(e) FROM w), 6) AS event_type_view FROM w
""")
def one_hot_scaled(spark, sf_dir):
    wide = one_hot_standardised(events_num(spark, sf_dir).select("value", "event_type"), ["event_type"])
    return wide.select(*[F.round(n, 6).alias(n) for n in wide.columns])


@query("""
WITH e AS (SELECT [quantile_cont(l_extendedprice, 0.1), quantile_cont(l_extendedprice, 0.2),
  quantile_cont(l_extendedprice, 0.3), quantile_cont(l_extendedprice, 0.4), quantile_cont(l_extendedprice, 0.5),
  quantile_cont(l_extendedprice, 0.6), quantile_cont(l_extendedprice, 0.7), quantile_cont(l_extendedprice, 0.8),
  quantile_cont(l_extendedprice, 0.9)] AS q FROM lineitem)
SELECT l_orderkey, l_extendedprice,
  CAST(len(list_filter(q, lambda t: l_extendedprice > t)) AS INTEGER) AS bin FROM lineitem, e
""")
def quantile_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    done = binning.assign_quantile_bins(rows, ["l_extendedprice"], 10)
    return done.select("l_orderkey", "l_extendedprice", F.col("l_extendedprice_bin").alias("bin"))


@query("""
WITH e AS (SELECT min(n_chars) AS a, quantile_cont(n_chars, 0.25) AS b, quantile_cont(n_chars, 0.5) AS c,
  quantile_cont(n_chars, 0.75) AS d, max(n_chars) AS f FROM documents),
binned AS (SELECT CASE WHEN n_chars > d THEN 3 WHEN n_chars > c THEN 2 WHEN n_chars > b THEN 1 ELSE 0 END AS bin, e.* FROM documents, e)
SELECT CASE bin WHEN 0 THEN format('{:,}–{:,}', CAST(trunc(a) AS BIGINT), CAST(trunc(b) AS BIGINT) - 1)
  WHEN 1 THEN format('{:,}–{:,}', CAST(trunc(b) AS BIGINT), CAST(trunc(c) AS BIGINT) - 1)
  WHEN 2 THEN format('{:,}–{:,}', CAST(trunc(c) AS BIGINT), CAST(trunc(d) AS BIGINT) - 1)
  ELSE format('{:,}–{:,}', CAST(trunc(d) AS BIGINT), CAST(trunc(f) AS BIGINT) - 1) END AS label, count(*) AS n
FROM binned GROUP BY 1
""")
def bin_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("n_chars")
    done = binning.assign_quantile_bins(rows, ["n_chars"], 4)
    return done.groupBy(F.col("n_chars_range").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT row_id, age, CASE WHEN age >= 90 THEN '90-99' ELSE
  CAST(age // 10 * 10 AS VARCHAR) || '-' || CAST(age // 10 * 10 + 9 AS VARCHAR) END AS age_group FROM orders_wide
""")
def age_bins(spark, sf_dir):
    rows = orders_wide(spark, sf_dir).select("row_id", "age")
    return rows.withColumn("age_group", binning.age_group(number("age")))


_TENTHS = "[" + ", ".join(f"quantile_cont(income, {i / 10})" for i in range(11)) + "]"


@query(f"""
WITH src AS (SELECT row_id, age, balance AS income, {_clean('status')} AS status FROM orders_wide),
filled AS (SELECT row_id, age, coalesce(income, (SELECT quantile_cont(income, 0.5) FROM src)) AS income, status FROM src),
e AS (SELECT list_sort(list_distinct({_TENTHS})) AS q FROM filled),
m AS (SELECT status AS top FROM src WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
spot AS (SELECT row_id, age, status, q, CAST(len(list_filter(q[2:len(q) - 1], lambda t: income > t)) AS INTEGER) AS b FROM filled, e)
SELECT row_id, CASE WHEN age >= 90 THEN '90-99' ELSE
    CAST(age // 10 * 10 AS VARCHAR) || '-' || CAST(age // 10 * 10 + 9 AS VARCHAR) END AS age,
  printf('%.2f–%.2f', q[b + 1], q[b + 2]) AS income, coalesce(status, top) AS status FROM spot, m
""")
def sensitive_groups(spark, sf_dir):
    rows = _clean_orders(spark, sf_dir, "row_id", "age", "balance", "status").withColumnRenamed("balance", "income")
    filled = impute.impute_median(rows, ["income"])
    return encode_sensitive(filled, ["age", "income", "status"]).select("row_id", "age", "income", "status")


@query("""
WITH m AS (SELECT avg(total) AS mean FROM orders_wide),
y AS (SELECT row_id, coalesce(total, mean) AS y FROM orders_wide, m)
SELECT row_id, CAST(y > (SELECT quantile_cont(y, 0.5) FROM y) AS INTEGER) AS label FROM y
""")
def binary_target_numeric(spark, sf_dir):
    rows = _clean_orders(spark, sf_dir, "row_id", "total")
    roles = collect_roles(rows, "total")
    return rows.select("row_id", target.binary_label(rows, "total", roles).alias("label"))


@query(f"SELECT row_id, CAST(coalesce({_clean('status')}, {_mode('status')}) = {_mode('status')} AS INTEGER) AS label FROM orders_wide")
def binary_target_class(spark, sf_dir):
    rows = _clean_orders(spark, sf_dir, "row_id", "status")
    roles = collect_roles(rows, "status")
    return rows.select("row_id", target.binary_label(rows, "status", roles).alias("label"))


@query("SELECT row_id, CAST(priority = '1-URGENT' AS INTEGER) AS label FROM orders_wide")
def binary_target_positive(spark, sf_dir):
    rows = orders_wide(spark, sf_dir)
    return rows.select("row_id", target.label_from_class("priority", "1-URGENT").alias("label"))


@query("""
WITH r AS (SELECT row_id, signal_label, row_number() OVER (PARTITION BY signal_label
    ORDER BY md5(CAST(row_id AS VARCHAR) || ':42')) AS r, count(*) OVER (PARTITION BY signal_label) AS n FROM orders_wide)
SELECT row_id, signal_label, r <= CAST(floor(n * 0.2::DOUBLE + 0.5) AS BIGINT) AS is_test FROM r
""")
def stratified_split(spark, sf_dir):
    rows = orders_wide(spark, sf_dir).select("row_id", "signal_label")
    return split.stratified_split(rows, "row_id", "signal_label")


@query("""
SELECT o_orderkey, o_orderpriority,
  substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) < '33333333' AS is_test FROM orders
""")
def hash_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return split.hash_split(rows, "o_orderkey")


@query("SELECT event_id, value FROM events WHERE substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 8) < '40000000'")
def sample_rows(spark, sf_dir):
    return split.sample_share(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 0.25)


@query("""
SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) < '33333333'
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42') LIMIT 10
""")
def first_test_rows(spark, sf_dir):
    rows = split.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return split.first_test_rows(rows, "o_orderkey", 10).select("o_orderkey")


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_TFIDF = f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(n) AS n FROM tf GROUP BY 1 ORDER BY n DESC, term LIMIT 3000),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1 AS idf FROM vocab),
w AS (SELECT doc_id, tf.term, n * idf AS raw FROM tf JOIN idf ON tf.term = idf.term),
len AS (SELECT doc_id, sqrt(sum(raw * raw)) AS length FROM w GROUP BY 1)
"""


@query(_TFIDF + "SELECT w.doc_id AS row_id, term, round(raw / length, 6) AS weight FROM w JOIN len ON w.doc_id = len.doc_id")
def tfidf(spark, sf_dir):
    weights = text.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return weights.select("row_id", "term", F.round("weight", 6).alias("weight"))


@query(_TFIDF + "SELECT term, round(idf, 6) AS idf FROM idf")
def text_vocabulary(spark, sf_dir):
    return text.vocabulary_table(table(spark, sf_dir, "documents"), "text").select("term", F.round("idf", 6).alias("idf"))


def _components_sql(steps: tuple[int, ...]) -> str:
    """CTEs v0, v1 ... (term, f): right singular vectors of the weights by power iteration, one after the other."""
    parts = ["""
u AS MATERIALIZED (SELECT w.doc_id, w.term, raw / length AS x FROM w JOIN len ON w.doc_id = len.doc_id),
words AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) AS i FROM vocab)"""]
    for j, count in enumerate(steps):
        parts.append(f"f{j}_0 AS MATERIALIZED (SELECT term, {'1.0::DOUBLE' if j == 0 else 'sin(i)'} AS f FROM words)")
        for i in range(count):
            parts.append(f"""
c{j}_{i} AS (SELECT doc_id, sum(x * f) AS c FROM u JOIN f{j}_{i} f ON u.term = f.term GROUP BY doc_id),
g{j}_{i}_0 AS MATERIALIZED (SELECT term, sum(x * c) AS f FROM u JOIN c{j}_{i} c ON u.doc_id = c.doc_id GROUP BY term)""")
            for before in range(j):
                parts.append(f"""
d{j}_{i}_{before} AS (SELECT sum(g.f * v.f) AS d FROM g{j}_{i}_{before} g JOIN v{before} v ON g.term = v.term),
g{j}_{i}_{before + 1} AS MATERIALIZED (SELECT g.term, g.f - d * v.f AS f FROM g{j}_{i}_{before} g JOIN v{before} v ON g.term = v.term, d{j}_{i}_{before})""")
            parts.append(f"f{j}_{i + 1} AS MATERIALIZED (SELECT term, f / (SELECT sqrt(sum(f * f)) FROM g{j}_{i}_{j}) AS f FROM g{j}_{i}_{j})")
        last = f"f{j}_{count}"
        parts.append(f"v{j} AS MATERIALIZED (SELECT term, f * sign((SELECT arg_max(f, abs(f)) FROM {last})) AS f FROM {last})")
    return ",".join(parts)


@query(_TFIDF + "," + _components_sql((40, 75)) + """,
p0 AS (SELECT doc_id, sum(x * f) AS p FROM u JOIN v0 ON u.term = v0.term GROUP BY doc_id),
p1 AS (SELECT doc_id, sum(x * f) AS p FROM u JOIN v1 ON u.term = v1.term GROUP BY doc_id)
SELECT documents.doc_id, round(coalesce(p0.p, 0), 6) + 0.0::DOUBLE AS text_svd_0, round(coalesce(p1.p, 0), 6) + 0.0::DOUBLE AS text_svd_1
FROM documents LEFT JOIN p0 ON documents.doc_id = p0.doc_id LEFT JOIN p1 ON documents.doc_id = p1.doc_id
""")
def text_svd(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = text.text_components(rows, "text", text.fit_text(rows, "text"))
    return found.select("doc_id", *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in ("text_svd_0", "text_svd_1")])


def _prepared(spark, sf_dir, mode: str, columns: list[str]):
    rows = materialise(orders_wide(spark, sf_dir).select("row_id", *columns, "signal_label"), "orders")
    done = features.build_features(rows, "row_id", "signal_label", mode, one_hot_encode=False)
    spot = features.feature_columns(rows)
    return done.data.select("row_id", *[F.col(spot[n]).alias(n) for n in columns], "label")


_MAJORITY = "CAST(signal_label = (SELECT signal_label FROM orders_wide GROUP BY 1 ORDER BY count(*) DESC, CAST(signal_label AS VARCHAR) LIMIT 1) AS INTEGER) AS label"


@query(f"""
SELECT row_id, coalesce(total, (SELECT quantile_cont(total, 0.5) FROM orders_wide)) AS total,
  coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM orders_wide)) AS balance,
  coalesce({_clean('status')}, '<MISSING>') AS status, {_MAJORITY}
FROM orders_wide
""")
def features_quality(spark, sf_dir):
    """Quality features before one-hot: medians, categories as they are, majority label."""
    return _prepared(spark, sf_dir, "quality", ["total", "balance", "status"])


def _clamped(name: str) -> str:
    return f"""{name}_r AS (SELECT {name} AS x, row_number() OVER (ORDER BY {name}) - 1 AS r, count(*) OVER () AS n FROM filled),
{name}_b AS (SELECT max(CASE WHEN r = CAST(floor(0.01::DOUBLE * n) AS BIGINT) THEN x END) AS lo,
  max(CASE WHEN r = n - 1 - CAST(floor(0.01::DOUBLE * n) AS BIGINT) THEN x END) AS hi FROM {name}_r),
{name}_c AS (SELECT row_id, least(greatest({name}, lo), hi) AS {name} FROM filled, {name}_b),
{name}_s AS (SELECT row_id, round(({name} - (SELECT avg({name}) FROM {name}_c)) / (SELECT stddev_pop({name}) FROM {name}_c), 8) AS {name} FROM {name}_c)"""


@query(f"""
WITH filled AS (SELECT row_id, coalesce(total, (SELECT quantile_cont(total, 0.5) FROM orders_wide)) AS total,
  coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM orders_wide)) AS balance, age, race, {_MAJORITY} FROM orders_wide),
{_clamped('total')}, {_clamped('balance')}
SELECT row_id, total_s.total, balance_s.balance, race, CASE WHEN age >= 90 THEN '90-99' ELSE
  CAST(age // 10 * 10 AS VARCHAR) || '-' || CAST(age // 10 * 10 + 9 AS VARCHAR) END AS age, label
FROM filled JOIN total_s USING (row_id) JOIN balance_s USING (row_id)
""")
def features_fairness(spark, sf_dir):
    """Fairness features before one-hot: clamped and scaled numbers, groups of sensitive columns."""
    done = _prepared(spark, sf_dir, "fairness", ["total", "balance", "race", "age"])
    return done.withColumns({n: F.round(n, 8) for n in ("total", "balance")})
