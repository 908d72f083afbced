"""Document fingerprints by Order MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let, partitions

# A piece is at most this many characters of a word, so text without spaces is cut as well.
PIECE = r"[^\x20\x09-\x0D]{1,6}"
SHINGLE = 3
BINS_LOG2 = 6
PER_BIN = 2
_PLACE_BITS = 24
_ROWS_PER_BLOCK = 20_000
_MOST_BLOCKS = 65_536


def _pack(value: Column, place: Column) -> Column:
    """The upper bits of a hash with a place below, so that one sort of longs orders both."""
    mask = (1 << _PLACE_BITS) - 1
    return value.bitwiseAND(F.lit(~mask)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(mask)))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def with_signature(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the Order MinHash signature of column ``text``, as array<long>.

    The text is cut into pieces (parts of words), every run of SHINGLE pieces is a k-mer, and a
    k-mer is numbered by how often it stood before, so repeats count. A hash orders the numbered
    k-mers and deals them into 2**BINS_LOG2 bins; of every bin the PER_BIN smallest are kept,
    put back into text order and hashed as a tuple together with the bin. Empty bins give no
    entry. Null and blank texts have the empty signature; shorter texts than one k-mer are one.

    All steps are sorts and transforms of the row's own arrays: no explode, no shuffle. The
    occurrence number is found by doubling steps back through the sorted k-mers, so a text of one
    repeated word costs n log n as well.
    """
    p, k, a, b = (f"__omh_{x}" for x in ("pieces", "raw", "first", "second"))
    pieces = F.col(p)
    steps = F.array(*[F.lit(1 << j) for j in range(_PLACE_BITS - 1, -1, -1)])

    def kmer(x: Column) -> Column:
        return F.shiftright(x, _PLACE_BITS)

    def numbered(x: Column, i: Column) -> Column:
        s = F.col(a)
        repeat = F.aggregate(
            steps, F.lit(0),
            lambda seen, step: F.when(
                (i - seen - step >= 0) & (kmer(F.get(s, i - seen - step)) == kmer(x)), seen + step
            ).otherwise(seen),
        )
        times = F.when((i > 0) & (kmer(F.get(s, i - 1)) == kmer(x)), repeat).otherwise(F.lit(0))
        return _pack(F.xxhash64(kmer(x), times), _place(x))

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - BINS_LOG2)

    def entry(x: Column, i: Column, kept: Column) -> Column:
        run = F.filter(F.slice(kept, i + 1, PER_BIN), lambda y: bin_of(y) == bin_of(x))
        in_text_order = F.array_sort(F.transform(run, lambda y: F.struct(_place(y), F.shiftright(y, _PLACE_BITS))))
        return F.when(
            (i == 0) | (bin_of(F.get(kept, i - 1)) != bin_of(x)),
            F.xxhash64(bin_of(x), F.transform(in_text_order, lambda y: y["col2"])),
        )

    starts = F.sequence(F.lit(0), F.greatest(F.size(pieces) - SHINGLE, F.lit(0)))
    shingles = F.when(F.size(pieces) > 0, F.transform(
        starts, lambda i: _pack(F.xxhash64(F.get(pieces, i), F.get(pieces, i + 1), F.get(pieces, i + 2)), i)
    )).otherwise(F.array().cast("array<long>"))
    smallest = F.filter(
        F.col(b), lambda x, i: (i < PER_BIN) | (bin_of(F.get(F.col(b), i - PER_BIN)) != bin_of(x))
    )
    signature = let(smallest, lambda kept: F.filter(
        F.transform(kept, lambda x, i: entry(x, i, kept)), lambda h: h.isNotNull()
    ))
    return (
        rows.withColumn(p, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)))
        .withColumn(a, F.sort_array(shingles))
        .withColumn(b, F.sort_array(F.transform(F.col(a), numbered)))
        .withColumn(out, signature)
        .drop(p, k, a, b)
    )


def digest(signature: Column) -> Column:
    """A signature as text: 32 hex digits."""
    return F.md5(F.to_json(F.struct(signature.alias("s"))).cast("binary"))


def likeness(left: Column, right: Column) -> Column:
    """Share of bins with the same tuple, 0 to 1; two empty signatures are alike."""
    most = F.greatest(F.size(left), F.size(right))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / most)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "signature") -> DataFrame:
    """All columns of ``docs`` and the signature of every row's whole text."""
    return with_signature(docs, text, out)


def _id_range(docs: DataFrame) -> Column:
    """Number of the range of ids a row is in: ranges of about equally many rows, null ids last."""
    n = docs.count()
    blocks = min(_MOST_BLOCKS, max(4 * partitions(docs.sparkSession), n // _ROWS_PER_BLOCK))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 8 * blocks)).first()[0] if n and shares else None
    cuts = sorted(set(cuts or []))
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    steps = F.array(*[F.lit(1 << j) for j in range(len(cuts).bit_length() - 1, -1, -1)]) if cuts else F.array().cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(found).cast("long")


def next_document(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the document that follows in doc_id order, as ``next_<column>``; after the last: the first.

    Null ids come last; rows of equal id are ordered by the text's digest. Ids are cut at
    their quantiles into ranges (at most 65,536), each is sorted on its own, and the first row of every range is also
    lent to the range before it, found in a table of one row per range.
    """
    block = _id_range(docs)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("t"))
    placed = docs.withColumns({"__next_block": block, "__next_at": order})
    ranges = placed.groupBy("__next_block").agg(F.min("__next_at").alias("__next_first"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("__next_block")
    ranges = ranges.withColumn("__next_lent", F.coalesce(
        F.lag("__next_block").over(by_range), F.max("__next_block").over(Window.partitionBy(F.lit(0)))
    ))
    lent = placed.join(F.broadcast(ranges), "__next_block")
    shared = lent.withColumn("__next_to", F.explode(F.when(
        F.col("__next_at") == F.col("__next_first"),
        F.array(F.struct(F.col("__next_block").alias("b"), F.lit(False).alias("g")),
                F.struct(F.col("__next_lent").alias("b"), F.lit(True).alias("g"))),
    ).otherwise(F.array(F.struct(F.col("__next_block").alias("b"), F.lit(False).alias("g"))))))
    window = Window.partitionBy("__next_to.b").orderBy("__next_to.g", "__next_at")
    return shared.select(
        *docs.columns, "__next_to", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    ).where(~F.col("__next_to.g")).drop("__next_to")


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document beside itself with its end replaced, and beside the next document.

    Reads doc_id and text. The last quarter of the code points gives way to as many of the next
    document's first ones. Null text is empty; an empty table gives no rows; a single document is
    its own next one. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and both signatures.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = next_document(fingerprints(own), ["text", "signature"])
    n, moved = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved)
    )).drop("text", "next_text")
    return with_signature(edited, "edited", "edited_signature").select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("signature")).alias("fingerprint"), digest(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
        "signature", "edited_signature",
    )
