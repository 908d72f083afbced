"""Missing values written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import c, columns_of_type, known, quote

# Texts that stand for a missing value (blank text always does).
MISSING_MARKERS = ("?", "NA", "N/A")

_BLANKS = " \t\n\r\f\v"


def without_marker(col: Column, markers: tuple[str, ...] = MISSING_MARKERS) -> Column:
    """NULL where a string is blank or one of the markers."""
    blank = F.btrim(col, F.lit(_BLANKS)) == ""
    return F.when(~(blank | col.isin(*markers)), col)


def normalise_missing(
    df: DataFrame,
    columns: list[str] | None = None,
    markers: tuple[str, ...] = MISSING_MARKERS,
) -> DataFrame:
    """Replace text markers and NaN by NULL, in one projection."""
    strings = set(columns_of_type(df, "string"))
    wanted = set(df.columns if columns is None else columns)
    out = []
    for field in df.schema.fields:
        name = field.name
        if name not in wanted:
            out.append(c(name))
        elif name in strings:
            out.append(without_marker(c(name), markers).alias(name))
        else:
            out.append(known(name, field.dataType).alias(name))
    return df.select(*out)


def drop_incomplete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any missing value, markers included."""
    subset = None if columns is None else [quote(n) for n in columns]
    return normalise_missing(df, columns).na.drop(subset=subset)


def to_number(col: Column) -> Column:
    """The value as a double, NULL where it is not a number."""
    return col.try_cast("double")
