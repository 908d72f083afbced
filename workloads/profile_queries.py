"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.columns import columns_of_type
from plumbline.functions.missing import drop_incomplete_rows, normalise_missing
from plumbline.operators import binning, describe, profile
from workloads.fixtures import doc_labels, events_num, orders_wide, table
from workloads.registry import query

_COLS = ["row_id", "total", "balance", "status", "priority", "age", "nationality", "race",
         "occupation", "order_month", "const_col", "target", "signal_label", "pred"]
_TYPES = {"row_id": "long", "total": "double", "balance": "double", "age": "long", "const_col": "integer",
          "target": "integer", "signal_label": "integer", "pred": "integer"}
_WIDTH = {"long": 8, "double": 8, "integer": 4}

_MISSING = " + ".join(f"CAST({n} IS NULL AS INTEGER)" for n in _COLS)
_BYTES = " + ".join(
    str(_WIDTH[_TYPES[n]]) if n in _TYPES else f"coalesce(strlen({n}), 0)" for n in _COLS)


@query(f"""
WITH groups AS (SELECT {', '.join(_COLS)}, count(*) AS n FROM orders_wide GROUP BY ALL),
totals AS (
  SELECT CAST(sum(n) AS BIGINT) AS r, CAST(sum(n * ({_MISSING})) AS BIGINT) AS m,
    CAST(sum(n - 1) AS BIGINT) AS d, CAST(sum(n * ({_BYTES})) AS BIGINT) AS b FROM groups)
SELECT 'Number of Columns' AS metric, '14' AS value FROM totals
UNION ALL SELECT 'Number of Records', CAST(r AS VARCHAR) FROM totals
UNION ALL SELECT 'Total Cells', CAST(r * 14 AS VARCHAR) FROM totals
UNION ALL SELECT 'Missing Cells', CAST(m AS VARCHAR) FROM totals
UNION ALL SELECT 'Missing Percentage', printf('%.2f%%', m * 100.0::DOUBLE / (r * 14)) FROM totals
UNION ALL SELECT 'Duplicate Records', CAST(d AS VARCHAR) FROM totals
UNION ALL SELECT 'Duplicate Percentage', printf('%.2f%%', d * 100.0::DOUBLE / r) FROM totals
UNION ALL SELECT 'Memory Usage', printf('%.2f KB', b / 1024.0::DOUBLE) FROM totals
UNION ALL SELECT 'Average Record Size', printf('%.2f Bytes', b / CAST(r AS DOUBLE)) FROM totals
""")
def dataset_summary(spark, sf_dir):
    return profile.dataset_summary(orders_wide(spark, sf_dir))


@query("""
WITH g AS (
  SELECT l_returnflag, l_linestatus, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g
""")
def duplicate_rows(spark, sf_dir):
    flags = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
    return profile.duplicate_rows(table(spark, sf_dir, "lineitem"), flags)


def _facts_sql(view: str, types: dict[str, str]) -> str:
    """Per-column counts, one UNION branch per column."""
    branches = []
    for i, (n, kind) in enumerate(types.items()):
        v = f"CAST({n} AS VARCHAR)"
        clean = f"CASE WHEN trim({v}, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND {v} NOT IN ('?', 'NA', 'N/A') THEN {v} END"
        branches.append(f"""
  SELECT {i} AS position, '{n}' AS col, '{kind}' AS dtype, count(*) AS rows,
    count(DISTINCT {v}) AS dist, count(*) - count({v}) AS missing,
    count(DISTINCT {clean}) AS clean_dist, count({clean}) AS clean_known,
    count(TRY_CAST({clean} AS DOUBLE)) AS castable,
    count(DISTINCT CASE WHEN TRY_CAST({v} AS DOUBLE) IS NOT NULL THEN {v} END) AS numeric_values,
    coalesce(max(length({v})), 0) AS max_len, CAST(coalesce(sum(strlen({v})), 0) AS BIGINT) AS text_bytes,
    min({v}) AS sample FROM {view}""")
    return "facts AS (" + " UNION ALL ".join(branches) + ")"


_ORDER_TYPES = {n: _TYPES.get(n, "string") for n in _COLS}
_SENSITIVE = {"age": "age", "nationality": "national_origin", "race": "race_ethnicity",
              "occupation": "socioeconomic"}
_KIND = "CASE col " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SENSITIVE.items()) + " END"


def _roles_sql(target: str | None) -> str:
    """Role rules over the facts."""
    number = "(dtype IN ('long', 'integer', 'double') OR (dtype = 'string' AND clean_known > 0 AND castable = clean_known))"
    return f"""roles AS (SELECT *, CASE
    WHEN col = '{target or ''}' THEN 'target'
    WHEN dist <= 1 THEN 'dropped'
    WHEN {number} AND clean_dist > 10 THEN 'numeric'
    WHEN {number} THEN 'categorical'
    WHEN dtype = 'string' AND dist * 1.0::DOUBLE / rows > 0.1::DOUBLE THEN 'text'
    ELSE 'categorical' END AS role, {_KIND} AS kind FROM facts)"""


@query(f"""
WITH {_facts_sql('orders_wide', _ORDER_TYPES)}, {_roles_sql('target')}
SELECT position, col, dtype, rows, dist AS "distinct", missing, clean_dist AS clean_distinct, role,
  CASE WHEN role NOT IN ('target', 'text') THEN kind END AS sensitive_kind,
  role NOT IN ('target', 'text') AND kind IS NOT NULL AS sensitive
FROM roles
""")
def column_roles(spark, sf_dir):
    return profile.column_roles(orders_wide(spark, sf_dir), "target")


@query(f"""
WITH {_facts_sql('orders_wide', _ORDER_TYPES)}, {_roles_sql(None)}
SELECT CASE r WHEN 'numeric' THEN 'Numeric Columns' WHEN 'categorical' THEN 'Categorical Columns'
  ELSE 'Text Columns' END AS column_type, count(*) AS columns
FROM (SELECT CASE WHEN role <> 'text' AND kind IS NOT NULL THEN 'categorical' ELSE role END AS r FROM roles)
WHERE r IN ('numeric', 'categorical', 'text') GROUP BY 1
""")
def role_counts(spark, sf_dir):
    return profile.role_counts(profile.column_roles(orders_wide(spark, sf_dir)))


@query(f"""
WITH {_facts_sql('orders_wide', _ORDER_TYPES)}, {_roles_sql(None)}
SELECT col, CASE WHEN role <> 'text' AND kind IS NOT NULL THEN 'categorical'
    WHEN role = 'dropped' THEN 'other' ELSE role END AS column_type,
  dist AS distinct_values, round(dist * 1.0::DOUBLE / rows * 100, 2) AS distinct_percentage,
  missing AS missing_values, round(missing * 1.0::DOUBLE / rows * 100, 2) AS missing_percentage,
  round(CASE dtype WHEN 'long' THEN 8 * rows WHEN 'double' THEN 8 * rows WHEN 'integer' THEN 4 * rows
    ELSE text_bytes END / 1024.0::DOUBLE, 2) AS data_kb
FROM roles
""")
def column_stats(spark, sf_dir):
    return profile.column_statistics(orders_wide(spark, sf_dir))


_ALERT_RULES = """
e AS (
  SELECT position, col, 'error' AS level, 1 AS seq, 'all_missing' AS code, 'has all values missing' AS tail FROM facts WHERE missing = rows
  UNION ALL SELECT position, col, 'error', 2, 'mostly_missing', printf('has more than 70%% missing values (%.2f%%)', missing * 100.0::DOUBLE / rows)
    FROM facts WHERE missing < rows AND missing > 0.7::DOUBLE * rows
  UNION ALL SELECT position, col, 'error', 3, 'constant', 'is entirely constant and may be irrelevant'
    FROM facts WHERE dist = 1 AND missing = 0 AND rows > 1
  UNION ALL SELECT position, col, 'error', 4, 'long_text', 'contains long strings (up to ' || max_len || ' characters)'
    FROM facts WHERE dtype = 'string' AND max_len > 275),
w AS (
  SELECT position, col, 'warning' AS level, 1 AS seq, 'some_missing' AS code,
    'has ' || missing || printf(' missing values (%.2f%%)', missing * 100.0::DOUBLE / rows) AS tail FROM facts WHERE missing > 0 AND missing < rows
  UNION ALL SELECT position, col, 'warning', 2, 'high_cardinality', 'has high cardinality (' || dist || ' unique values)'
    FROM facts WHERE dist > 0.9::DOUBLE * rows AND dist < rows
  UNION ALL SELECT position, col, 'warning', 3, 'mixed_types', 'has mixed data types'
    FROM facts WHERE dtype = 'string' AND numeric_values > 0 AND numeric_values < dist
  UNION ALL SELECT position, col, 'warning', 4, 'long_text', 'contains long strings (up to ' || max_len || ' characters)'
    FROM facts WHERE dtype = 'string' AND NOT (numeric_values > 0 AND numeric_values < dist) AND max_len > 100),
i AS (
  SELECT position, col, 'info' AS level, 1 AS seq, 'complete' AS code, 'has no missing values' AS tail FROM facts WHERE missing = 0
  UNION ALL SELECT position, col, 'info', 2, 'all_unique', 'has all unique values' FROM facts WHERE dist = rows
  UNION ALL SELECT position, col, 'info', 3, 'single_value', 'has constant value "' || sample || '"' FROM facts WHERE dist = 1 AND missing < rows),
found AS (
  SELECT * FROM e
  UNION ALL SELECT * FROM w WHERE col NOT IN (SELECT col FROM e)
  UNION ALL SELECT * FROM i WHERE col NOT IN (SELECT col FROM e) AND col NOT IN (SELECT col FROM w))
SELECT level, col, code, 'Column "' || col || '" ' || tail AS message FROM found
"""


@query(f"WITH {_facts_sql('orders_wide', _ORDER_TYPES)}, {_ALERT_RULES}")
def alerts(spark, sf_dir):
    return profile.alerts(orders_wide(spark, sf_dir))


_DOC_TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


@query(f"WITH {_facts_sql('documents', _DOC_TYPES)}, {_ALERT_RULES}")
def alerts_documents(spark, sf_dir):
    return profile.alerts(table(spark, sf_dir, "documents"))


@query("""
WITH counts AS (SELECT nationality AS value, count(*) AS n FROM orders_wide GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS r, sum(n) OVER () AS rows FROM counts),
folded AS (
  SELECT value, n, rows, FALSE AS folded FROM ranked WHERE r <= 20
  UNION ALL SELECT 'Other', sum(n), any_value(rows), TRUE FROM ranked WHERE r > 20 HAVING count(*) > 0)
SELECT value, CAST(n AS BIGINT) AS n, round(n * 1.0::DOUBLE / rows * 100, 1) AS pct, folded FROM folded
""")
def value_counts_topn(spark, sf_dir):
    return profile.top_value_counts(orders_wide(spark, sf_dir), "nationality")


@query("""
WITH s AS (
  SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.75) AS q3 FROM events_num),
b AS (
  SELECT *, CAST(ceil((hi - lo) / least(2 * (q3 - q1) / pow(n, 1.0::DOUBLE / 3), (hi - lo) / (log2(n) + 1))) AS INTEGER) AS bins FROM s),
spots AS (
  SELECT least(CAST(floor((value - lo) / (hi - lo) * bins) AS INTEGER), bins - 1) AS bin, count(*) AS n
  FROM events_num, b GROUP BY 1),
grid AS (SELECT unnest(range(bins)) AS bin, lo, hi, bins FROM b)
SELECT CAST(grid.bin AS INTEGER) AS bin, round(lo + grid.bin * ((hi - lo) / bins), 6) AS lo,
  round(lo + (grid.bin + 1) * ((hi - lo) / bins), 6) AS hi, coalesce(spots.n, 0) AS n
FROM grid LEFT JOIN spots ON grid.bin = spots.bin
""")
def histogram(spark, sf_dir):
    bins = binning.histogram(events_num(spark, sf_dir), "value")
    return bins.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _NUMBERS for b in _NUMBERS))
def correlation(spark, sf_dir):
    pairs = describe.correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return pairs.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


def _describe_sql(view: str, types: dict[str, str]) -> str:
    parts = []
    for n, kind in types.items():
        num = kind != "string"
        stat = (lambda e: f"round({e}, 6)") if num else (lambda e: "CAST(NULL AS DOUBLE)")
        parts.append(f"""SELECT '{n}' AS col, count({n}) AS count, count(DISTINCT {n}) AS unique,
  (SELECT v FROM (SELECT CAST({n} AS VARCHAR) AS v, count(*) AS k FROM {view} WHERE {n} IS NOT NULL GROUP BY 1)
     ORDER BY k DESC, v LIMIT 1) AS top,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM {view} WHERE {n} IS NOT NULL GROUP BY {n})) AS freq,
  {stat(f'avg({n})')} AS mean, {stat(f'stddev_samp({n})')} AS std, {stat(f'CAST(min({n}) AS DOUBLE)') if num else 'CAST(NULL AS DOUBLE)'} AS min,
  {stat(f'quantile_cont(CAST({n} AS DOUBLE), 0.25)')} AS q25, {stat(f'quantile_cont(CAST({n} AS DOUBLE), 0.5)')} AS q50,
  {stat(f'quantile_cont(CAST({n} AS DOUBLE), 0.75)')} AS q75, {stat(f'CAST(max({n}) AS DOUBLE)') if num else 'CAST(NULL AS DOUBLE)'} AS max FROM {view}""")
    return " UNION ALL ".join(parts)


_EVENT_TYPES = {"row_id": "long", "user_id": "long", "event_type": "string", "value": "double", "k": "integer"}


@query(_describe_sql("events_num", _EVENT_TYPES))
def describe_columns(spark, sf_dir):
    d = describe.describe_columns(events_num(spark, sf_dir))
    rounded = [F.round(n, 6).alias(n) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return d.select("col", "count", "unique", "top", "freq", *rounded)


def _clean_sql(n: str) -> str:
    return f"CASE WHEN trim({n}) <> '' AND {n} NOT IN ('?', 'NA', 'N/A') THEN {n} END"


@query(f"SELECT row_id, {_clean_sql('status')} AS status, {_clean_sql('priority')} AS priority, order_month, total FROM orders_wide")
def missing_normalised(spark, sf_dir):
    return normalise_missing(orders_wide(spark, sf_dir)).select(
        "row_id", "status", "priority", "order_month", "total")


@query(f"""
SELECT row_id, status, priority, total, balance FROM (
  SELECT row_id, {_clean_sql('status')} AS status, {_clean_sql('priority')} AS priority, total, balance FROM orders_wide)
WHERE status IS NOT NULL AND priority IS NOT NULL AND total IS NOT NULL AND balance IS NOT NULL
""")
def complete_rows(spark, sf_dir):
    wanted = orders_wide(spark, sf_dir).select("row_id", "status", "priority", "total", "balance")
    return drop_incomplete_rows(wanted)


_TEXTS = ["status", "priority", "nationality", "race", "occupation", "order_month"]


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS col, CAST(count_if({n} IS NULL" + (f" OR {n} = ''" if n in _TEXTS else "")
    + ") AS BIGINT) AS null_or_empty FROM orders_wide" for n in _COLS))
def null_or_empty(spark, sf_dir):
    return profile.null_or_empty_counts(orders_wide(spark, sf_dir))


@query("""
SELECT lang, count(*) AS rows, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(n_chars) AS BIGINT) AS chars
FROM doc_labels GROUP BY lang
""")
def attach_target(spark, sf_dir):
    joined = doc_labels(spark, sf_dir)
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("good"), F.sum("n_chars").alias("chars"))


@query("""
SELECT col, count(*) AS known FROM (
  UNPIVOT (SELECT l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem)
  ON l_extendedprice, l_quantity, l_discount, l_tax INTO NAME col VALUE v) GROUP BY 1
""")
def numeric_column_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    doubles = [n for n in columns_of_type(lines, "number") if lines.schema[n].dataType.typeName() == "double"]
    one = lines.agg(*[F.count(n).alias(n) for n in doubles])
    return one.unpivot([], doubles, "col", "known")
