"""Views over the given tables that the queries audit, in Spark and as SQL.

The given tables have no gaps, so some values are blanked by a rule on the key; no row is
ever left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer, nation and region."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("o_orderkey")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    score = (
        (F.coalesce(_gap(key, 17, F.col("o_totalprice")), F.lit(250000.0)) - 250000.0) / 100000.0
        + (F.coalesce(_gap(key, 23, F.col("c_acctbal")), F.lit(4500.0)) - 4500.0) / 10000.0
    )
    signal = F.col("o_totalprice") > 250000.0
    return joined.select(
        key.alias("row_id"),
        _gap(key, 17, F.col("o_totalprice")).alias("total"),
        _gap(key, 23, F.col("c_acctbal")).alias("balance"),
        F.when(key % 19 == 0, "?").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 29 == 0, " ").otherwise(F.col("o_orderpriority")).alias("priority"),
        (15 + F.col("o_custkey") % 80).alias("age"),
        F.col("n_name").alias("nationality"),
        F.col("r_name").alias("race"),
        F.col("c_mktsegment").alias("occupation"),
        F.month("o_orderdate").cast("string").alias("order_month"),
        F.lit(1).alias("const_col"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("target"),
        F.when(key % 10 == 0, ~signal).otherwise(signal).cast("int").alias("signal_label"),
        (score > 0).cast("int").alias("pred"),
    )


def _gap(key, every: int, value):
    return F.when(key % every != 0, value)


ORDERS_WIDE_SQL = """
orders_wide AS (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS total,
    CASE WHEN o_orderkey % 23 <> 0 THEN c_acctbal END AS balance,
    CASE WHEN o_orderkey % 19 = 0 THEN '?' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE o_orderpriority END AS priority,
    15 + o_custkey % 80 AS age,
    n_name AS nationality, r_name AS race, c_mktsegment AS occupation,
    CAST(month(o_orderdate) AS VARCHAR) AS order_month,
    1 AS const_col,
    CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS target,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN NOT (o_totalprice > 250000.0)
         ELSE o_totalprice > 250000.0 END AS INTEGER) AS signal_label,
    CAST((coalesce(CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END, 250000.0::DOUBLE) - 250000.0::DOUBLE) / 100000.0::DOUBLE
       + (coalesce(CASE WHEN o_orderkey % 23 <> 0 THEN c_acctbal END, 4500.0::DOUBLE) - 4500.0::DOUBLE) / 10000.0::DOUBLE > 0
      AS INTEGER) AS pred
  FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a prediction from their length."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("row_id"), "quality", "toxic", "lang", "source", "n_chars", "text",
        (F.col("n_chars") > 600).cast("int").alias("pred"),
    )


DOC_LABELS_SQL = """
doc_labels AS (
  SELECT l.doc_id AS row_id, quality, toxic, lang, source, n_chars, text,
    CAST(n_chars > 600 AS INTEGER) AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def events_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number inside their properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVENTS_NUM_SQL = """
events_num AS (
  SELECT event_id AS row_id, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
