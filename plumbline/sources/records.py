"""Records of text files of any size, framed in parallel: quoted line breaks and arrays of JSON records.

Where a record ends cannot be seen from the bytes around it: a line break may stand inside quotes,
a bracket inside a string. But what a stretch of a file does to the reader's state can be told
without knowing that state: for each state it may begin in, the state it ends in and by how much it
changes the nesting. Such maps compose. So files are read in two passes over Spark's own splits:

1. every split reduces its segments (lines, or what stands between closing braces) to one map;
2. the maps, one row for each split of the scan, are composed in file order, which gives the state
   every split begins in; splits then cut their records on their own. What is left over at either
   end of a split travels to be put together with its neighbours'.

No task holds more than its split and one record, however large a file is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAPS = ["from_out", "from_in", "deeper_out", "deeper_in"]


@dataclass(frozen=True)
class Framing:
    """How text falls into segments, and which of them end a record.

    ``maps`` gives for a segment whether the next one begins inside quotes, if it began outside and
    inside them, and by how much it nests deeper in either case. A record ends with a segment after
    which the text is outside quotes and ``depth`` levels deep.
    """

    delimiter: str
    depth: int
    maps: tuple[Column, Column, Column, Column]


def csv_framing(sep: str) -> Framing:
    """Lines; a quote opens a value at its start only, and two quotes inside one are a quote."""
    field_start = f"(^|\\Q{sep}\\E)"
    line = F.replace(F.col("value"), F.lit('""'), F.lit(""))

    def opens(text: Column) -> Column:
        return F.regexp(F.regexp_replace(text, field_start + '"[^"]*"', "$1"), F.lit(field_start + '"'))

    quote = F.instr(line, '"')
    rest = F.concat(F.lit("x"), F.substr(line, quote + 1))
    none = F.lit(0)
    quoted = F.contains(F.col("value"), F.lit('"'))
    return Framing("\n", 0, (quoted & opens(line), ~quoted | (quote == 0) | opens(rest), none, none))


def json_framing() -> Framing:
    """What stands between closing braces; a record is an object directly inside the outer array."""
    pieces = F.split(F.regexp_replace(F.col("value"), r"(?s)\\.", ""), '"')
    odd = F.size(pieces) % 2 == 0  # an odd number of quotes: inside and outside change places

    def deeper(inside: int, then_inside: Column) -> Column:
        seen = F.concat_ws(" ", F.filter(pieces, lambda _, i: i % 2 == inside))
        change = F.regexp_count(seen, F.lit(r"[\[{]")) - F.regexp_count(seen, F.lit(r"[\]}]"))
        return (change - F.when(then_inside, 0).otherwise(1)).cast("int")

    return Framing("}", 1, (odd, ~odd, deeper(0, odd), deeper(1, ~odd)))


def _segments(spark: SparkSession, files: list[str], framing: Framing) -> DataFrame:
    text = spark.read.text(files, lineSep=framing.delimiter)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    maps = [m.cast("int").alias(n) for m, n in zip(framing.maps, _MAPS)]
    return text.select(*where, F.col("value").cast("binary").alias("value"), *maps)


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that come from one split."""
    start = batch.column("start").to_numpy(zero_copy_only=False)
    file = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = (np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1).tolist()
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
        if hi > lo:
            yield (batch.column("file")[lo].as_py(), int(start[lo])), batch.slice(lo, hi - lo)


def _states(maps: list[np.ndarray], inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the text is inside quotes after each segment, and how deep, if it begins as given.

    A segment either leads to one state from both, or keeps or swaps them: the state is that of the
    last one of the first kind, turned as often as segments swapped since.
    """
    out, into, deeper_out, deeper_in = maps
    at = np.arange(len(out))
    last = np.maximum.accumulate(np.where(out == into, at, -1))
    swaps = np.cumsum((out == 1) & (into == 0))
    after = np.where(last >= 0, out[last], inside) ^ ((swaps - np.where(last >= 0, swaps[last], 0)) & 1)
    before = np.concatenate([[int(inside)], after[:-1]])
    return after, depth + np.cumsum(np.where(before == 1, deeper_in, deeper_out))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in _MAPS]


def split_states(segments: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """The state in which each split of the scan begins, where it is not outside and at depth 0.

    One row for each split comes to the driver, as many as it plans tasks for anyway.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for batch in batches:
            for key, part in _splits(batch):
                maps = _columns(part)
                ends = []
                for inside, depth in rows.get(key, [(0, 0), (1, 0)]):
                    after, deep = _states(maps, bool(inside), depth)
                    ends.append((int(after[-1]), int(deep[-1])))
                rows[key] = ends
        values = [(*key, a, b, c, d) for key, ((a, c), (b, d)) in rows.items()]
        names = ["file", "start", *_MAPS]
        kinds = [pa.string(), pa.int64(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], names=names)

    kind = "file string, start long, " + ", ".join(f"{n} long" for n in _MAPS)
    found = segments.select("file", "start", *_MAPS).mapInArrow(reduce, kind).collect()
    states, file = {}, None
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth = r["file"], 0, 0
        if inside or depth:
            states[file, r["start"]] = (bool(inside), depth)
        inside, depth = (r["from_in"], depth + r["deeper_in"]) if inside else (r["from_out"], depth + r["deeper_out"])
    return states


def records(spark: SparkSession, files: list[str], framing: Framing) -> DataFrame:
    """The records of all files: file, first (whether it is the file's first), ended and record (binary).

    Records that lie within a split leave as they are read; pieces of others are put together by
    file and place, which moves about one record for each split. Text after the last record of a
    file is a record of its own that has not ended.
    """
    segments = _segments(spark, files, framing)
    states = split_states(segments)
    mark = framing.delimiter.encode()
    target = framing.depth

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[int, int] = (0, 0)
        open_, whole = [], True  # segments since the last record ended; whether their record began in this split
        at, first = None, False

        def rows(texts: list[bytes], kind: str, heads: list[bool] | None = None) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array([kind] * n, pa.string()),
                 pa.array(heads or [False] * n, pa.bool_()), pa.array(texts, pa.binary())],
                names=["file", "start", "kind", "first", "record"])

        def left() -> Iterator[pa.RecordBatch]:
            if open_:
                yield rows([mark.join(open_)], "begun" if whole else "middle", [first])

        for batch in batches:
            for key, part in _splits(batch):
                if key != at:
                    if at:
                        yield from left()
                    inside, depth = states.get(key, (False, 0))
                    state, at, open_, first = (int(inside), depth), key, [], key[1] == 0
                    whole = first or (not inside and depth == target)
                after, deep = _states(_columns(part), bool(state[0]), state[1])
                state = (int(after[-1]), int(deep[-1]))
                texts = part.column("value").to_pylist()
                done: list[bytes] = []
                heads: list[bool] = []
                last = 0
                for end in (np.flatnonzero((after == 0) & (deep == target)) + 1).tolist():
                    text = texts[last] if end == last + 1 and not open_ else mark.join([*open_, *texts[last:end]])
                    last, open_ = end, []
                    if whole:
                        done.append(text)
                        heads.append(first)
                    else:
                        yield rows([text], "ended")
                    whole, first = True, False
                open_ += texts[last:]
                if done:
                    yield rows(done, "whole", heads)
        if at:
            yield from left()

    kinds = "file string, start long, kind string, first boolean, record binary"
    found = segments.mapInArrow(cut, kinds)
    pieces = found.where("kind <> 'whole'")
    # In a split a piece that ends a record comes before one that begins the next.
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "begun")
    pieces = pieces.withColumn("number", F.count_if(F.col("kind") == "begun").over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", F.col("kind") == "begun", "record")))
    text = F.array_join(F.transform(parts, lambda p: F.hex(p["record"])), mark.hex().upper())
    joined = pieces.groupBy("file", "number").agg(
        F.bool_or("first").alias("first"), F.bool_or(F.col("kind") == "ended").alias("ended"), F.unhex(text).alias("record"))
    whole = found.where("kind = 'whole'").select("file", "first", F.lit(True).alias("ended"), "record")
    return whole.unionByName(joined.drop("number"))


def parsed(texts: DataFrame, fmt: str, schema: T.StructType | str | None, **options) -> DataFrame:
    """Rows of a one-column table of record texts, by Spark's own parser of the format."""
    spark = texts.sparkSession
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader._jreader, fmt)(strings), spark)
