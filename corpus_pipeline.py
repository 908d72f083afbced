"""From raw documents to packed training sequences: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. Between stages the rows are written as Parquet and read again, so a
lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import copies, mixing, packing, quality, repeats
from plumbline.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says good: neither junk nor toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    model = quality.fit(docs, labels)
    return quality.judge(docs, model, F.col("source"), F.col("lang")).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts alike in 0.8 or more of their 5-word shingles, the smallest doc_id."""
    return copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold; n_chars is counted anew."""
    left = repeats.remove_repeats(docs, whole_characters=True)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of every source up to its target, repeated where the target asks for it."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

# Tokens and classifiers are beyond SQL: the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
