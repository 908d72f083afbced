"""Reading a dataset by location: format dispatch, delimiter and encoding, file choice."""

from __future__ import annotations

import codecs
import csv
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import c
from plumbline.sources.records import csv_framing, json_framing, parsed, records

# File formats by extension, delimiters looked for, and bytes looked at.
FORMATS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".parquet": "parquet"}
DELIMITERS = [",", ";", "\t", "|"]
SNIFFED_BYTES = 10_000
# Encodings whose line feed is one byte and that the engine decodes.
FRAMED = {"UTF-8", "UTF8", "ISO-8859-1", "LATIN-1", "LATIN1", "US-ASCII", "ASCII"}


def first_bytes(spark: SparkSession, path: str, size: int = SNIFFED_BYTES) -> bytes:
    """The start of a file on any file system Spark can reach."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = min(size, fs.getFileStatus(location).getLen())
    stream = fs.open(location)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, wanted))
    finally:
        stream.close()


def guess_encoding(sample: bytes) -> str:
    """Encoding by byte-order mark, else UTF-8 if the bytes allow it, else Latin-1."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16")):
        if sample.startswith(mark):
            return name
    try:
        # A character cut off at the end of the sample is no evidence against UTF-8.
        codecs.getincrementaldecoder("utf-8")().decode(sample, final=False)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def guess_delimiter(text: str) -> str:
    """The delimiter that cuts the most lines into the same number of fields; a comma if none does.

    Each candidate parses the whole sample, quotes included; the best has the largest share of lines
    with its commonest field count, and among equals the most fields.
    """
    lines = text.splitlines(keepends=True)
    if len(lines) > 1 and not lines[-1].endswith(("\n", "\r")):
        lines = lines[:-1]  # the sample may end inside a line

    def fit(sep: str) -> tuple[float, int]:
        widths = [len(row) for row in csv.reader(lines, delimiter=sep) if row]
        common = max(set(widths), key=widths.count, default=1)
        return (widths.count(common) / len(widths), common) if common > 1 else (0.0, 0)

    best = max(DELIMITERS, key=fit)
    return best if fit(best)[1] else ","


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder with a supported extension, by name; a file is its own list."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(location):
        raise FileNotFoundError(path)
    if fs.getFileStatus(location).isFile() or extension(path):
        return [path]
    found = [s.getPath().toString() for s in fs.listStatus(location)]
    return sorted(p for p in found if extension(p))


def extension(path: str) -> str | None:
    ext = posixpath.splitext(path.rstrip("/"))[1].lower()
    return ext if ext in FORMATS else None


def pick_file(spark: SparkSession, path: str, number: int = 1) -> str:
    """The ``number``-th supported file of a dataset, counted from 1; 0 means the last."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"{path}: no file with a supported format ({', '.join(FORMATS)})")
    if not 0 <= number <= len(files):
        raise IndexError(f"{path}: file {number} asked for, but there are {len(files)} files")
    return files[number - 1]


def table_files(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """All files of a dataset and their common format."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"{path}: no file with a supported format ({', '.join(FORMATS)})")
    kinds = {extension(f) for f in files}
    if len(kinds) > 1:
        raise ValueError(f"{path}: files of several formats ({', '.join(sorted(map(str, kinds)))}); choose one by number")
    return files, kinds.pop() or ""


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, number: int | None = None,
    schema=None, multiline_json: bool | None = None, sep: str | None = None,
    encoding: str | None = None, corrupt_column: str | None = None,
) -> DataFrame:
    """Load a file, or a folder of part files as one table, by extension.

    ``number`` picks one file of a folder instead (from 1; 0 is the last). Delimited text gets what
    ``sep`` and ``encoding`` leave open from its content; the rows are read by the cluster. Pass
    a schema to spare the pass that infers types. JSON is an array of records if it begins with a
    bracket, and one record per line otherwise; large arrays are cut into records in parallel.
    ``corrupt_column`` adds the raw text of records that do not fit the columns.
    """
    if fmt:
        files, kind = [path], fmt
    elif number is None:
        files, ext = table_files(spark, path)
        kind = FORMATS.get(ext, "")
    else:
        files = [pick_file(spark, path, number)]
        kind = FORMATS.get(extension(files[0]) or "", "")
    if kind == "parquet":
        return spark.read.parquet(*files)
    if kind == "json":
        start = first_bytes(spark, a_file(spark, files[0]))
        if multiline_json is None:
            multiline_json = start.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[")
        if multiline_json and guess_encoding(start) == "UTF-8":
            return read_json_arrays(spark, files, schema, corrupt_column)
        reader = spark.read.schema(schema) if schema else spark.read
        if corrupt_column:
            reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        return reader.json(files, multiLine=multiline_json)
    if kind == "csv":
        return read_delimited(spark, files, schema, sep, encoding, corrupt_column)
    raise ValueError(f"{path}: unsupported format {kind!r}")


def a_file(spark: SparkSession, path: str) -> str:
    """The path itself, or the first data file of a written folder."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(location).isFile():
        return path
    inside = [s for s in fs.listStatus(location) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", "."))]
    if not inside:
        raise ValueError(f"{path}: no data file")
    return min(s.getPath().toString() for s in inside)


def _text_facts(spark: SparkSession, files: list[str]) -> tuple[bool, bool, list[bytes]]:
    """Over whole files: whether all bytes are UTF-8, whether any line ends inside quotes, and the
    different first lines the files have."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    each = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open"),
        F.min_by(line.cast("binary"), "place").alias("head"))
    row = each.agg(
        F.coalesce(F.bool_and("utf8"), F.lit(True)).alias("utf8"), F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"),
        F.collect_set("head").alias("heads")).first()
    return row.utf8, row.open, [bytes(h) for h in row.heads]


def _one_delimiter(heads: list[str], first: str) -> None:
    """Refuses files whose headers fall into columns by another delimiter than the table's."""
    for head in heads:
        found = guess_delimiter(head)
        if found != first and found in head and first not in head:
            raise ValueError(f"files of one table are delimited by {first!r} and by {found!r} ({head[:80]!r}); choose one by number or pass sep")


def read_delimited(
    spark: SparkSession, files: list[str] | str, schema=None, sep: str | None = None,
    encoding: str | None = None, corrupt_column: str | None = None,
) -> DataFrame:
    """Delimited text with a header.

    One pass over all lines tells whether quoted values hold line breaks, whether the text is UTF-8
    throughout (if not, and no encoding was given, it is Latin-1) and what headers the files have.
    Text with quoted breaks is framed into records by :mod:`plumbline.sources.records`, so files are
    split like any other; only UTF-16 and text without line feeds is read a file to a task. The
    delimiter comes from the start of the first file; other files must agree.
    """
    files = [files] if isinstance(files, str) else files
    sample = first_bytes(spark, a_file(spark, files[0]))
    guessed = encoding or guess_encoding(sample)
    breaks, heads = True, []
    if not guessed.upper().startswith("UTF-16"):
        utf8, breaks, heads = _text_facts(spark, files)
        if not encoding and guessed == "UTF-8" and not utf8:
            guessed = "ISO-8859-1"
    if not sep:
        sep = guess_delimiter(sample.decode(guessed, errors="replace"))
        _one_delimiter([h.decode(guessed, errors="replace") for h in heads], sep)
    framed = breaks and guessed.upper() in FRAMED and not (b"\r" in sample and b"\n" not in sample)
    if framed:
        return _read_framed(spark, files, schema, sep, guessed, corrupt_column)
    options = dict(header=True, sep=sep, encoding=guessed, escape='"', quote='"', multiLine=breaks, mode="PERMISSIVE")
    if schema is None:
        schema = spark.read.csv(files, inferSchema=True, **options).schema
    schema = _with_corrupt(schema, corrupt_column, options)
    return spark.read.schema(schema).csv(files, **options)


def _engine_name(encoding: str) -> str:
    name = codecs.lookup(encoding).name
    return {"utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}[name]


def _with_corrupt(schema: T.StructType, corrupt_column: str | None, options: dict) -> T.StructType:
    if corrupt_column:
        options["columnNameOfCorruptRecord"] = corrupt_column
        return T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
    return schema


def _read_framed(spark: SparkSession, files: list[str], schema, sep: str, encoding: str, corrupt_column: str | None) -> DataFrame:
    """Delimited text with line breaks inside quotes, by its records; the first of each file is a header."""
    found = records(spark, files, csv_framing(sep))
    text = F.regexp_replace(F.decode("record", _engine_name(encoding)), "\\r\\z", "")
    texts = found.select("file", "first", F.when(F.col("first"), F.ltrim(text, F.lit("\ufeff"))).otherwise(text).alias("text"))
    options = dict(sep=sep, escape='"', quote='"', multiLine=True, mode="PERMISSIVE")
    body = texts.where(~F.col("first") & (F.trim("text") != "")).select("text")
    if schema is None:
        head = texts.where("first").groupBy().agg(F.min_by("text", "file").alias("text"))
        names = parsed(head, "csv", None, header=True, **options).columns
        kinds = [f.dataType for f in parsed(body, "csv", None, header=False, inferSchema=True, **options).schema]
        kinds += [T.StringType()] * (len(names) - len(kinds))
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    schema = _with_corrupt(schema, corrupt_column, options)
    return parsed(body, "csv", schema, header=False, **options)


def read_json_arrays(spark: SparkSession, files: list[str], schema=None, corrupt_column: str | None = None) -> DataFrame:
    """Files that hold an array of records each, cut into records in parallel at any size and layout."""
    found = records(spark, files, json_framing())
    text = F.regexp_replace(F.decode("record", "UTF-8"), r"^[\s,\[\x{feff}]+", "")
    texts = found.select("ended", text.alias("text")).where(F.col("ended") | ~F.regexp("text", F.lit(r"^[\s\]]*\z")))
    body = texts.select(F.when(F.col("ended"), F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("text"))
    options = {"columnNameOfCorruptRecord": corrupt_column} if corrupt_column else {}
    return parsed(body, "json", schema, **options)


def attach_target(features: DataFrame, target: DataFrame, key: str, name: str) -> DataFrame:
    """Add a target kept in a table of its own, matched by row id."""
    side = target.select(c(key), c([n for n in target.columns if n != key][0]).alias(name))
    return features.join(side, key, "left")


