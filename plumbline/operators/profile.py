"""Profiling: dataset summary, column statistics, roles and alerts.

Everything about single columns comes from one table of value frequencies
``(col, value, n)``. Counting is combined on the map side, so a value that fills a
third of the rows travels as one record per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import c, known
from plumbline.functions.missing import to_number, without_marker
from plumbline.functions.sensitive import sensitive_kind

# Thresholds of the column rules.
MIN_NUMERIC_DISTINCT = 10
TEXT_DISTINCT_SHARE = 0.1
MISSING_ERROR_SHARE = 0.7
LONG_TEXT_ERROR = 275
LONG_TEXT_WARNING = 100


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``(col, value, n)`` per distinct value of each column, NULL included."""
    fields = [f for f in df.schema.fields if columns is None or f.name in set(columns)]
    texts = [known(f.name, f.dataType).cast("string").alias(f.name) for f in fields]
    long = df.select(*texts).unpivot([], [c(f.name) for f in fields], "col", "value")
    return long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def short_key(name: str, dtype: T.DataType) -> Column:
    """The value for comparisons: long texts are replaced by a digest, so they do not travel."""
    if not isinstance(dtype, T.StringType):
        return c(name)
    return F.when(F.length(c(name)) > LONG_TEXT_WARNING, F.md5(c(name))).otherwise(c(name))


def _row_bytes(df: DataFrame) -> Column:
    """Plain data size of a row: fixed widths plus the bytes of its strings."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        total = total + _value_bytes(c(field.name), field.dataType)
    return total


def _value_bytes(value: Column, dtype: T.DataType) -> Column:
    widths = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(dtype, T.ArrayType):
        each = widths.get(dtype.elementType.typeName(), 8)
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("long") * each
    return F.lit(widths.get(dtype.typeName(), 8)).cast("long")


def _row_digest(keys: list[Column]) -> list[Column]:
    """Two independent 64-bit hashes of a row's values; each value counts with its NULL flag."""
    parts = [x for k in keys for x in (k, k.isNull())]
    return [F.xxhash64(F.lit(1), *parts).alias("_one"), F.xxhash64(F.lit(2), *reversed(parts)).alias("_two")]


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows ``(metric, value)``: size, missing cells, duplicates and data volume.

    One shuffle of 16 bytes a row: rows are grouped on a digest of all their values, and each group
    carries its size.
    """
    n_cols = len(df.columns)
    missing = sum(
        (known(f.name, f.dataType).isNull().cast("long") for f in df.schema.fields), F.lit(0).cast("long"))
    keys = [short_key(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    rows = df.select(*_row_digest(keys), missing.alias("_missing"), _row_bytes(df).alias("_bytes"))
    groups = rows.groupBy("_one", "_two").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_missing").alias("_missing"), F.sum("_bytes").alias("_bytes"))
    totals = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("dups"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"),
    )
    cells = c("rows") * n_cols

    def share(part: Column, whole: Column) -> Column:
        pct = F.coalesce(F.try_divide(part.cast("double"), whole) * 100, F.lit(0.0))
        return F.format_string("%.2f%%", pct)

    per_row = F.coalesce(F.try_divide(c("bytes").cast("double"), c("rows")), F.lit(0.0))
    items = [
        ("Number of Columns", F.lit(n_cols).cast("string")),
        ("Number of Records", c("rows").cast("string")),
        ("Total Cells", cells.cast("string")),
        ("Missing Cells", c("missing").cast("string")),
        ("Missing Percentage", share(c("missing"), cells)),
        ("Duplicate Records", c("dups").cast("string")),
        ("Duplicate Percentage", share(c("dups"), c("rows"))),
        ("Memory Usage", F.format_string("%.2f KB", c("bytes") / 1024)),
        ("Average Record Size", F.format_string("%.2f Bytes", per_row)),
    ]
    pairs = [F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in items]
    return totals.select(F.inline(F.array(*pairs)))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of rows, distinct rows and repeats over the given columns (NULLs are equal)."""
    names = df.columns if columns is None else columns
    keys = [short_key(n, df.schema[n].dataType).alias(f"k{i}") for i, n in enumerate(names)]
    groups = df.select(*_row_digest(keys)).groupBy("_one", "_two").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _profile_frequencies(df: DataFrame) -> DataFrame:
    """Value frequencies in which a long text is its digest, length, size and number flag.

    Only texts that raise a length alert anyway are shortened, so no report shows a digest.
    """
    cells = []
    for f in df.schema.fields:
        text = known(f.name, f.dataType).cast("string")
        long = F.length(text) > LONG_TEXT_WARNING
        cells.append(F.struct(
            F.when(long, F.md5(text)).otherwise(text).alias("value"),
            F.when(long, F.length(text)).alias("length"),
            F.when(long, F.octet_length(text)).alias("size"),
            # Other texts fail the pattern at their first letter, before any parsing.
            F.when(long, text.rlike(r"^[-+0-9.eE \t]+$") & to_number(text).isNotNull()).alias("number"),
        ).alias(f.name))
    cell = df.select(*cells).unpivot([], [c(f.name) for f in df.schema.fields], "col", "cell")
    return cell.select("col", "cell.*").groupBy("col", "value", "length", "size", "number").agg(
        F.count(F.lit(1)).alias("n"))


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column with the counts that roles, statistics and alerts build on.

    ``distinct`` and ``missing`` describe the stored values; ``clean_distinct`` and
    ``clean_known`` leave out missing markers; ``castable`` counts numbers among them.
    """
    fields = df.schema.fields
    value, n, long = c("value"), c("n"), c("length").isNotNull()
    clean = F.when(long, value).otherwise(without_marker(value))
    is_number = F.when(long, c("number")).otherwise(to_number(value).isNotNull())
    length = F.coalesce(c("length"), F.length(value))
    size = F.coalesce(c("size"), F.octet_length(value)).cast("long")
    facts = _profile_frequencies(df).groupBy("col").agg(
        F.sum(n).alias("rows"),
        F.count(value).alias("distinct"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("missing"),
        F.count(clean).alias("clean_distinct"),
        F.coalesce(F.sum(F.when(clean.isNotNull(), n)), F.lit(0)).alias("clean_known"),
        F.coalesce(F.sum(F.when(clean.isNotNull() & is_number, n)), F.lit(0)).alias("castable"),
        F.count_if(value.isNotNull() & is_number).alias("numeric_values"),
        F.max(length).alias("max_len"),
        F.coalesce(F.sum(size * n), F.lit(0)).alias("text_bytes"),
        F.min(value).alias("sample"),
    )
    # The schema side is as small as the schema; the left join keeps columns of empty tables.
    rows = [(i, f.name, f.dataType.typeName(), _fixed_width(f.dataType)) for i, f in enumerate(fields)]
    schema = "position int, col string, dtype string, width int"
    names = df.sparkSession.createDataFrame(rows, schema)
    zero = {k: 0 for k in ("rows", "distinct", "missing", "clean_distinct", "clean_known",
                           "castable", "numeric_values", "text_bytes")}
    return names.join(facts, "col", "left").na.fill(zero)


def _fixed_width(dtype: T.DataType) -> int | None:
    if isinstance(dtype, (T.StringType, T.BinaryType, T.ArrayType)):
        return None
    return {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}.get(
        dtype.typeName(), 8
    )


NUMBER_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")


def column_roles(
    df: DataFrame,
    target: str | None = None,
    sensitive_match: str = "substring",
    extra_sensitive: list[str] | None = None,
) -> DataFrame:
    """Role of every column: numeric, categorical, text, dropped or target.

    Columns without two distinct values are dropped. Numbers, or text that is all numbers
    once missing markers are gone, are numeric above ten distinct values. Other text is
    ``text`` if more than a tenth of the rows differ. The rest is categorical.
    """
    return _with_roles(df, column_facts(df), target, sensitive_match, extra_sensitive).select(
        "position", "col", "dtype", "rows", "distinct", "missing", "clean_distinct", "role",
        "sensitive_kind", "sensitive",
    )


def _with_roles(
    df: DataFrame, facts: DataFrame, target: str | None = None,
    sensitive_match: str = "substring", extra_sensitive: list[str] | None = None,
) -> DataFrame:
    all_numbers = (c("clean_known") > 0) & (c("castable") == c("clean_known"))
    numeric_like = c("dtype").isin(*NUMBER_TYPES) | ((c("dtype") == "string") & all_numbers)
    share = F.try_divide(c("distinct"), c("rows"))
    target_flag = F.lit(False) if target is None else c("col") == target
    role = (
        F.when(target_flag, "target")
        .when(c("distinct") <= 1, "dropped")
        .when(numeric_like & (c("clean_distinct") > MIN_NUMERIC_DISTINCT), "numeric")
        .when(numeric_like, "categorical")
        .when((c("dtype") == "string") & (share > TEXT_DISTINCT_SHARE), "text")
        .otherwise("categorical")
    )
    kinds = {n: sensitive_kind(n, sensitive_match) for n in df.columns}
    kinds.update({n: kinds[n] or "listed" for n in extra_sensitive or []})
    kind = F.lit(None).cast("string")
    for name, found in kinds.items():
        if found:
            kind = F.when(c("col") == name, found).otherwise(kind)
    roles = facts.withColumns({"role": role, "_kind": kind})
    eligible = ~c("role").isin("target", "text")
    return roles.withColumn(
        "sensitive_kind", F.when(eligible, c("_kind"))
    ).withColumn("sensitive", c("sensitive_kind").isNotNull()).drop("_kind")


def effective_role(role: Column, sensitive: Column, numeric_target: Column | None = None) -> Column:
    """Role after sensitive columns are treated as categorical."""
    return F.when(sensitive, "categorical").otherwise(role)


@dataclass(frozen=True)
class Roles:
    """Column roles brought to the driver: as small as the schema."""

    numeric: list[str]
    categorical: list[str]
    text: list[str]
    dropped: list[str]
    sensitive: dict[str, str]
    numeric_target: bool
    rows: int
    distinct: dict[str, int]


def collect_roles(df: DataFrame, target: str | None = None, **options) -> Roles:
    rows = column_roles(df, target, **options).orderBy("position").collect()
    by_role = {r: [x.col for x in rows if x.role == r] for r in
               ("numeric", "categorical", "text", "dropped")}
    numeric_target = False
    if target is not None:
        t = next(x for x in rows if x.role == "target")
        numeric_target = t.clean_distinct > MIN_NUMERIC_DISTINCT and (
            t.dtype in NUMBER_TYPES or _all_numbers(df, target))
    return Roles(
        by_role["numeric"], by_role["categorical"], by_role["text"], by_role["dropped"],
        {x.col: x.sensitive_kind for x in rows if x.sensitive}, numeric_target,
        max((x.rows for x in rows), default=0), {x.col: x.clean_distinct for x in rows},
    )


def _all_numbers(df: DataFrame, name: str) -> bool:
    bad = F.count_if(without_marker(c(name).cast("string")).isNotNull() & to_number(c(name)).isNull())
    return df.agg(bad.alias("bad")).first().bad == 0


def role_counts(roles: DataFrame) -> DataFrame:
    """Number of numeric, categorical and text columns, sensitive ones as categorical."""
    role = effective_role(c("role"), c("sensitive"))
    counts = roles.select(role.alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("columns"))
    labels = F.create_map(*[F.lit(x) for x in (
        "numeric", "Numeric Columns", "categorical", "Categorical Columns", "text", "Text Columns")])
    return (
        counts.where(c("role").isin("numeric", "categorical", "text"))
        .select(labels[c("role")].alias("column_type"), "columns")
        .orderBy("column_type")
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """Type, distinct and missing counts with shares, and plain data size per column."""
    stats = _with_roles(df, column_facts(df))
    role = effective_role(c("role"), c("sensitive"))
    size = F.coalesce(c("rows") * c("width"), c("text_bytes"))

    def pct(part: Column) -> Column:
        return F.round(F.try_divide(part.cast("double"), c("rows")) * 100, 2)

    return stats.select(
        "col",
        F.when(role == "dropped", "other").otherwise(role).alias("column_type"),
        c("distinct").alias("distinct_values"),
        pct(c("distinct")).alias("distinct_percentage"),
        c("missing").alias("missing_values"),
        pct(c("missing")).alias("missing_percentage"),
        F.round(size / 1024.0, 2).alias("data_kb"),
    )


def alerts(df: DataFrame, missing_threshold: float = MISSING_ERROR_SHARE) -> DataFrame:
    """Quality alerts ``(level, col, code, message)``, most severe first.

    Errors hide warnings and warnings hide notes of the same column. A text column counts
    as mixed when some, but not all, of its values are numbers.
    """
    f = column_facts(df)
    rows, missing, distinct = c("rows"), c("missing"), c("distinct")
    is_text = c("dtype") == "string"
    share = F.try_divide(missing.cast("double"), rows)
    longest = F.coalesce(c("max_len"), F.lit(0))
    mixed = is_text & (c("numeric_values") > 0) & (c("numeric_values") < distinct)
    pct = F.format_string("%.2f", share * 100)

    def say(*parts) -> Column:
        return F.concat(F.lit('Column "'), c("col"), F.lit('" '),
                        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def alert(when: Column, level: str, code: str, message: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(
            F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message")))

    all_missing = missing == rows
    long_message = say("contains long strings (up to ", longest, " characters)")
    errors = [
        alert(all_missing, "error", "all_missing", say("has all values missing")),
        alert(~all_missing & (share > missing_threshold), "error", "mostly_missing",
              say(f"has more than {missing_threshold * 100:.0f}% missing values (", pct, "%)")),
        alert((distinct == 1) & (missing == 0) & (rows > 1), "error", "constant",
              say("is entirely constant and may be irrelevant")),
        alert(is_text & (longest > LONG_TEXT_ERROR), "error", "long_text", long_message),
    ]
    warnings = [
        alert((missing > 0) & (missing < rows), "warning", "some_missing",
              say("has ", missing, " missing values (", pct, "%)")),
        alert((distinct > rows * 0.9) & (distinct < rows), "warning", "high_cardinality",
              say("has high cardinality (", distinct, " unique values)")),
        alert(mixed, "warning", "mixed_types", say("has mixed data types")),
        alert(is_text & ~mixed & (longest > LONG_TEXT_WARNING), "warning", "long_text", long_message),
    ]
    notes = [
        alert(missing == 0, "info", "complete", say("has no missing values")),
        alert(distinct == rows, "info", "all_unique", say("has all unique values")),
        alert((distinct == 1) & (missing < rows), "info", "single_value",
              say('has constant value "', c("sample"), '"')),
    ]
    for name, found in (("e", errors), ("w", warnings), ("i", notes)):
        f = f.withColumn(name, F.array_compact(F.array(*found)))
    chosen = (
        F.when(F.size("e") > 0, c("e")).when(F.size("w") > 0, c("w")).otherwise(c("i"))
    )
    severity = F.when(c("level") == "error", 0).when(c("level") == "warning", 1).otherwise(2)
    return (
        f.select("position", "col", F.posexplode(chosen).alias("seq", "alert"))
        .select("position", "seq", "alert.level", "col", "alert.code", "alert.message")
        .orderBy(severity, "position", "seq")
        .select("level", "col", "code", "message")
    )


def top_value_counts(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Most frequent values of a column, the rest folded into ``Other``, with shares.

    NULL is a value of its own. The top is taken without a global sort and the two uses of
    the counts share one shuffle.
    """
    counts = df.groupBy(c(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(c("n").desc(), c("value").asc_nulls_first()).limit(limit)
    folded = top.agg(
        F.collect_list(F.struct("value", "n", F.lit(False).alias("folded"))).alias("top"),
        F.sum("n").alias("kept"),
    )
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    one = folded.unionByName(totals, allowMissingColumns=True).agg(
        *[F.max(x).alias(x) for x in ("top", "kept", "rows", "values")]
    )
    other = F.struct(
        F.lit("Other").alias("value"), (c("rows") - c("kept")).alias("n"), F.lit(True).alias("folded")
    )
    lines = F.when(c("values") > limit, F.concat("top", F.array(other))).otherwise(c("top"))
    return one.select("rows", F.inline(lines)).select(
        "value", "n", F.round(c("n") / c("rows") * 100, 1).alias("pct"), "folded"
    )


def null_or_empty_counts(df: DataFrame) -> DataFrame:
    """Per column: how many values are NULL or the empty string."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    flags = []
    for f in df.schema.fields:
        empty = known(f.name, f.dataType).isNull()
        if f.name in strings:
            empty = empty | (c(f.name) == "")
        flags.append(F.count_if(empty).alias(f.name))
    one = df.agg(*flags)
    return one.unpivot([], [c(n) for n in df.columns], "col", "null_or_empty")
