"""Writing tables and audit results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c

REPORT_SCHEMA = "section string, item string, metric string, value string"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keep a normalised copy of an input."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def tidy(section: str, df: DataFrame, item: str | None = None) -> DataFrame:
    """A result table as rows ``(section, item, metric, value)``.

    ``item`` names the column that tells the rows apart, if there is more than one row.
    Maps and other nested values are written as JSON.
    """
    shown = []
    for f in df.schema.fields:
        nested = f.dataType.typeName() in ("map", "array", "struct")
        shown.append((F.to_json(c(f.name)) if nested else c(f.name).cast("string")).alias(f.name))
    texts = df.select(*shown)
    metrics = [n for n in df.columns if n != item]
    key = F.coalesce(c(item), F.lit("")) if item else F.lit("")
    cells = [F.struct(F.lit(n).alias("metric"), c(n).alias("value")) for n in metrics]
    return texts.select(F.lit(section).alias("section"), key.alias("item"), F.inline(F.array(*cells)))


def write_report(report: DataFrame, path: str) -> None:
    """Store a tidy report, one folder per section."""
    report.write.mode("overwrite").partitionBy("section").parquet(path)
