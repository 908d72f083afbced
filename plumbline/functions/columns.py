"""Column access by exact name, and columns by physical type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    """Backtick-quoted identifier, safe for names with dots, spaces or brackets."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """The column with exactly this name."""
    return F.col(quote(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Columns whose physical type is ``number``, ``string``, ``bool`` or ``other``."""

    def kind_of(dtype: T.DataType) -> str:
        if is_numeric(dtype):
            return "number"
        if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
            return "string"
        if isinstance(dtype, T.BooleanType):
            return "bool"
        return "other"

    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def known(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into NULL, as both mean missing."""
    return F.when(~F.isnan(c(name)), c(name)) if is_float(dtype) else c(name)


def without_clashes(df: DataFrame, reserved: tuple[str, ...], prefix: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed that an audit's own columns would overwrite, and {new: old}.

    Names are compared without regard to case, as Spark does; ``prefix`` reserves all names with it.
    """
    taken = {n.lower() for n in df.columns}
    old: dict[str, str] = {}
    for name in df.columns:
        low = name.lower()
        if low in reserved or (prefix and low.startswith(prefix)):
            k = 1
            while f"{low} ({k})" in taken or f"{low} ({k})" in reserved:
                k += 1
            new = f"raw {name}" if f"raw {low}" not in taken else f"raw {name} ({k})"
            taken.add(new.lower())
            old[new] = name
    back = {v: k for k, v in old.items()}
    return df.select(*[c(n).alias(back.get(n, n)) for n in df.columns]), old
