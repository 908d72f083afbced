"""Sources and sinks: a given table written out in a format and read back through the loader."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.session import session_folder
from plumbline.sources import readers, sinks
from workloads.fixtures import table
from workloads.registry import query

_PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _folder(spark, name: str) -> str:
    return f"{session_folder(spark)}/sources-{name}"


# Megabytes of stored input that one task writes as one file, give or take a split.
FILE_MB = 200


def _few_files(df):
    """The rows in as few partitions as hold FILE_MB of stored input each, one at least."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    files = math.ceil(size / (FILE_MB * 1e6))
    # Splits are joined as they are; if there are too few of them, rows are dealt out.
    return df.coalesce(max(1, files)) if files <= df.rdd.getNumPartitions() else df.repartition(files)


def _typed(df):
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_type",
                     F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query(_PART)
def source_csv(spark, sf_dir):
    path = _folder(spark, "part.csv")
    sinks.write_table(_part(spark, sf_dir), path, "csv")
    return _typed(readers.load_table(spark, path))


@query("SELECT doc_id, text, lang FROM documents")
def source_csv_quoted_breaks(spark, sf_dir):
    """Texts with line breaks, quotes and separators, whole, through delimited text."""
    path = _folder(spark, "documents.csv")
    sinks.write_table(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "csv")
    schema = "doc_id long, text string, lang string"
    return readers.load_table(spark, path, schema=_schema(spark, schema))


def _schema(spark, text: str):
    return spark.createDataFrame([], text).schema


@query(_PART)
def source_tsv(spark, sf_dir):
    path = _folder(spark, "part.tsv")
    _part(spark, sf_dir).write.mode("overwrite").option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return _typed(readers.load_table(spark, path))


@query(_PART)
def source_json(spark, sf_dir):
    path = _folder(spark, "part.json")
    _part(spark, sf_dir).write.mode("overwrite").json(path)
    return _typed(readers.load_table(spark, path))


@query("SELECT doc_id, text, lang, source FROM documents")
def source_csv_one_large_file(spark, sf_dir):
    """Texts with line breaks in one quoted file, which any number of tasks read.

    A file is written by one task, so a table of more than FILE_MB becomes several such files.
    """
    path = _folder(spark, "documents-one.csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    _few_files(docs).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.load_table(spark, path, schema=_schema(spark, "doc_id long, text string, lang string, source string"))


@query(_PART)
def source_json_array(spark, sf_dir):
    """One file with one array of records, cut into records by the tasks that read it."""
    path = _folder(spark, "part-array.json")
    part = _part(spark, sf_dir)
    first = part.agg(F.min("p_partkey")).first()[0]
    lines = part.select("p_partkey", F.concat(F.when(F.col("p_partkey") == first, "[").otherwise(","), F.to_json(F.struct(*part.columns))).alias("line"))
    end = spark.createDataFrame([(None, "]")], "p_partkey long, line string")
    lines.unionByName(end).orderBy(F.col("p_partkey").asc_nulls_last()).select("line").coalesce(1).write.mode("overwrite").text(path)
    return _typed(readers.load_table(spark, path))


@query(_PART)
def source_part_files(spark, sf_dir):
    """A folder of part files is one table."""
    path = _folder(spark, "parts")
    _part(spark, sf_dir).repartition(5, "p_partkey").write.mode("overwrite").parquet(path)
    return _typed(readers.load_table(spark, path))


@query(_PART)
def source_numbered_files(spark, sf_dir):
    """Files of a folder, asked for by number, make up the table together."""
    path = _folder(spark, "numbered")
    _part(spark, sf_dir).repartition(3, "p_partkey").write.mode("overwrite").parquet(path)
    count = len(readers.list_files(spark, path))
    parts = [readers.load_table(spark, path, number=i) for i in range(1, count + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _typed(out)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority AS target FROM orders")
def source_attached_target(spark, sf_dir):
    """Features and target in two files, joined on the row id."""
    orders = table(spark, sf_dir, "orders")
    features, target = _folder(spark, "features"), _folder(spark, "target")
    sinks.write_table(orders.select("o_orderkey", "o_totalprice"), features)
    sinks.write_table(orders.select("o_orderkey", "o_orderpriority"), target)
    return readers.attach_target(readers.load_table(spark, features), readers.load_table(spark, target), "o_orderkey", "target")


@query("""
SELECT 'orders' AS section, CAST(o_orderkey AS VARCHAR) AS item, unnest(['o_orderstatus', 'o_custkey']) AS metric,
  unnest([o_orderstatus, CAST(o_custkey AS VARCHAR)]) AS value FROM orders
""")
def sink_report(spark, sf_dir):
    """A tidy report stored by section and read back."""
    path = _folder(spark, "report")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus", "o_custkey")
    sinks.write_report(sinks.tidy("orders", rows, "key"), path)
    return spark.read.schema(sinks.REPORT_SCHEMA).parquet(path).where("metric <> 'key'")
