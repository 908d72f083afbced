"""Token ids: encoding, flat block files, and counts by scanning for separators."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
# The byte-level vocabulary's pretokeniser and its end-of-document id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
BLOCK_IDS = 1 << 18
_BLOCKS_PER_CHUNK = 1024
# Runs of white space from this length on are cut out of a text before it is encoded.
_LONG = 100_000
_LONG_GAP = regex.compile(r"\p{White_Space}{%d,}" % _LONG)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """An encoder with the ids of the vocabulary file at ``path``, kept by each worker.

    Gives the ids that the tokenizers library gives for the file (tests compare them), several
    times as fast. Special tokens' strings in a text are ordinary text.
    """
    import tiktoken

    letters = _byte_letters()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _added(path: str) -> tuple[regex.Pattern | None, dict[str, int]]:
    """The strings that the vocabulary file gives ids of their own, and those ids."""
    with open(path, encoding="utf-8") as file:
        found = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}
    names = sorted(found, key=len, reverse=True)
    return (regex.compile("|".join(map(regex.escape, names))) if names else None), found


def _plain(path: str, text: str) -> list[np.ndarray]:
    """Ids of ordinary text. All but the last character of a long run of white space (all, at the
    text's end) is one piece by the pattern, and is given to the encoder as such: its own search
    for the end of the run has a limit."""
    encoder, out, at = encoding(path), [], 0
    for run in _LONG_GAP.finditer(text) if len(text) >= _LONG else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(encoder.encode_to_numpy(text[at:run.start()], disallowed_special=()))
        out.append(np.array(encoder._encode_single_piece(text[run.start():end]), np.uint32))
        at = end
    out.append(encoder.encode_to_numpy(text[at:], disallowed_special=()))
    return out


def encode(path: str, text: str | None, added: bool = False) -> np.ndarray:
    """Ids of a whole text as uint32; null gives none.

    The vocabulary file's added tokens are ordinary text, so that no text can hold a separator; with
    ``added`` they get their own ids, as the tokenizers library does by default.
    """
    if not text:
        return np.empty(0, np.uint32)
    pattern, ids = _added(path)
    parts, at = [], 0
    for found in pattern.finditer(text) if added and pattern else ():
        parts += [*_plain(path, text[at:found.start()]), np.array([ids[found.group()]], np.uint32)]
        at = found.end()
    parts += _plain(path, text[at:])
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.uint32, copy=False)


def write_blocks(docs: DataFrame, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token streams of ``docs`` in flat blocks, one stream per input partition.

    Reads doc_id and text. Every document is its ids and then the separator, end to end; blocks of
    ``block_ids`` little-endian uint16 ids cut the stream anywhere. Rows: stream, block, ids
    (binary) and, for naming the counts afterwards, first_document and doc_ids: the documents that
    end in this block. Null text is a separator alone. A task holds one block and one document,
    however long. A vocabulary with ids beyond 65,535 is an error.
    """
    path = vocabulary or vocabulary_path()
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        ends: list[tuple[int, object]] = []
        held, written, block, document = 0, 0, 0, 0
        end = np.array([END_OF_DOCUMENT], np.uint16)

        def out(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal written, block, document
            written += len(ids)
            names = [name for at, name in ends if at <= written]
            del ends[: len(names)]
            row = pa.RecordBatch.from_arrays(
                [pa.array([stream], pa.int64()), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([document], pa.int64()), pa.array([names], pa.list_(kind))],
                names=["stream", "block", "ids", "first_document", "doc_ids"])
            block, document = block + 1, document + len(names)
            return row

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(path, text.as_py())
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("blocks hold 16-bit ids; this vocabulary has larger ones")
                ids = ids.astype(np.uint16)
                waiting += [ids, end]
                held += len(ids) + 1
                ends.append((written + held, doc_id))
                if held >= block_ids:
                    flat = np.concatenate(waiting)
                    full = held // block_ids * block_ids
                    for at in range(0, full, block_ids):
                        yield out(flat[at:at + block_ids])
                    waiting, held = [flat[full:]], held - full
        if held:
            yield out(np.concatenate(waiting))

    return docs.select("doc_id", "text").mapInArrow(
        run, f"stream long, block long, ids binary, first_document long, doc_ids array<{key}>"
    )


def read_flat_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, id_bytes: int = 2) -> DataFrame:
    """Blocks (stream, block, ids) of flat binary id files; the stream is the file's path.

    Spark reads a file whole, so files must fit a task; a corpus is many such files.
    """
    size = block_ids * id_bytes
    files = spark.read.format("binaryFile").load(path)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size) - 1, F.lit(0))))
    return files.where("length > 0").select(F.col("path").alias("stream"), starts.alias("block"), "content").select(
        "stream", F.col("block").cast("long").alias("block"),
        F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("ids"),
    )


def document_counts(blocks: DataFrame, separator: int = END_OF_DOCUMENT, id_bytes: int = 2) -> DataFrame:
    """Token counts of the documents in flat, unindexed streams of blocks.

    Reads stream, block (from 0, in order) and ids (binary, little-endian). Each block is searched
    for the separator in one vector comparison. A prefix scan over block summaries (ids, documents
    ended, last separator) tells every block where it stands in its stream and where its first
    document began, so documents that cross any number of blocks are stitched. The scan runs in
    chunks of blocks and then over the chunks. Returns stream, document (from 0), start (id position
    of the first token), n_tokens (without the separator) and closed (false for ids after the last
    separator). Null or empty blocks hold no ids; an empty table gives no rows.
    """
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_py() or b"", kind)
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["stream", "block", "n_ids", "seps"])

    stream = blocks.schema["stream"].dataType.simpleString()
    searched = blocks.select("stream", "block", "ids").mapInArrow(
        search, f"stream {stream}, block long, n_ids long, seps array<int>")
    found = searched.withColumn("chunk", F.floor(F.col("block") / _BLOCKS_PER_CHUNK))
    ended = F.size("seps")
    inside = Window.partitionBy("stream", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("_at") + F.element_at("seps", -1)
    in_chunk = (
        found.withColumn("_at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .withColumn("_docs", F.coalesce(F.sum(ended).over(inside), F.lit(0)))
        .withColumn("_last", F.when(ended > 0, last))
        .withColumn("_before", F.max("_last").over(inside))
    )
    sums = in_chunk.groupBy("stream", "chunk").agg(
        F.sum("n_ids").alias("ids"), F.sum(ended).alias("docs"), F.max("_last").alias("last"))
    over = Window.partitionBy("stream").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("chunk_at", F.coalesce(F.sum("ids").over(over), F.lit(0)))
    starts = starts.select(
        "stream", "chunk", "chunk_at", F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("chunk_docs"),
        F.max(F.col("chunk_at") + F.col("last")).over(over).alias("chunk_before"),
        (F.lead("chunk").over(Window.partitionBy("stream").orderBy("chunk"))).isNull().alias("final"),
    )
    placed = in_chunk.join(starts, ["stream", "chunk"]).select(
        "stream", "block", (F.col("chunk_at") + F.col("_at")).alias("at"), (F.col("chunk_docs") + F.col("_docs")).alias("docs"),
        (F.coalesce(F.col("chunk_at") + F.col("_before"), F.col("chunk_before"), F.lit(-1)) + 1).alias("began"), "seps", "n_ids",
        (F.col("final") & F.lead("block").over(Window.partitionBy("stream", "chunk").orderBy("block")).isNull()).alias("final"),
    )
    seps = F.transform("seps", lambda p: F.col("at") + p)
    open_end = F.col("at") + F.col("n_ids")
    began_last = F.when(F.size("seps") > 0, F.element_at(seps, -1) + 1).otherwise(F.col("began"))
    tail = F.col("final") & (began_last < open_end)
    ends = F.when(tail, F.concat(seps, F.array(open_end))).otherwise(seps)
    each = placed.withColumn("_ends", ends).withColumn("_closed", F.size("seps")).where(F.size("_ends") > 0).select(
        "stream", "docs", "began", "_ends", "_closed", F.posexplode("_ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("began")).otherwise(F.get("_ends", F.col("i") - 1) + 1)
    return each.select(
        "stream", (F.col("docs") + F.col("i")).alias("document"), start.alias("start"),
        (F.col("end") - start).alias("n_tokens"), (F.col("i") < F.col("_closed")).alias("closed"),
    )


def named_counts(blocks: DataFrame) -> DataFrame:
    """doc_id and n_tokens for blocks that :func:`write_blocks` made: counts by scan, names by place."""
    names = blocks.where(F.size("doc_ids") > 0).select(
        "stream", "first_document", F.posexplode("doc_ids").alias("i", "doc_id")
    ).select("stream", (F.col("first_document") + F.col("i")).alias("document"), "doc_id")
    return document_counts(blocks).join(names, ["stream", "document"]).select("doc_id", "n_tokens")
