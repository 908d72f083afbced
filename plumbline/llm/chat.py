"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import present, running_start

# Fixed values of the template.
ASSISTANT = "<|assistant|>\n"
USER = "<|user|>{}: "
END = "<|end|>\n"
UNNAMED = "unknown"
_TURNS_PER_BLOCK = 1024


def rotate(turns: DataFrame) -> DataFrame:
    """Every conversation once per participant: that speaker as assistant, others as named users.

    Reads conv_id, turn, role and text; a participant is a distinct role, null or blank: "unknown".
    One row per conversation, speaker and turn: conv_id, speaker, turn, role (assistant or user),
    name (null for the assistant), segment (the rendered turn), start (where it stands in the
    rendered dialogue, in code points), mask_start and mask_length (the part to learn from: the
    speaker's own text and end mark; length 0 for others).

    Turns are ordered by turn (null first), speaker and text; repeated rows are turns of their own.
    Null text is empty. Null conv_id is one conversation. A dialogue is never gathered: places come
    from sums over blocks of turns, so one conversation may hold a third of all rows.
    """
    said = turns.select(
        "conv_id", present(F.col("conv_id")).alias("conv"), "turn",
        F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit(UNNAMED)).alias("by"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    speakers = said.select("conv", F.col("by").alias("speaker")).distinct()
    own = F.col("by") == F.col("speaker")
    head = F.when(own, F.lit(ASSISTANT)).otherwise(F.format_string(USER.format("%s"), "by"))
    views = said.join(speakers, "conv").withColumn("own", own).withColumn("head", head)
    views = views.withColumn("segment", F.concat("head", "text", F.lit(END))).withColumn(
        "size", F.length("segment").cast("long")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / _TURNS_PER_BLOCK), F.lit(-(1 << 62))).cast("long"))
    placed = running_start(
        views, ["conv", "speaker"], "block", [F.col("turn").asc_nulls_first(), F.col("by"), F.col("text")], "size", "start")
    return placed.select(
        "conv_id", "speaker", "turn", F.when(F.col("own"), "assistant").otherwise("user").alias("role"),
        F.when(~F.col("own"), F.col("by")).alias("name"), "segment", "start",
        (F.col("start") + F.length("head")).alias("mask_start"),
        F.when(F.col("own"), F.col("size") - F.length("head")).otherwise(0).alias("mask_length"),
    )


def render(segments: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """Dialogues as texts: conv_id, speaker, part, text, start and masks (start, length) in the dialogue.

    A dialogue longer than ``part_chars`` comes in several parts, cut between turns, so that no
    task has to hold more; joined in order, the parts are the dialogue.
    """
    part = F.floor(F.col("start") / part_chars)
    pieces = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_length")))
    return segments.groupBy("conv_id", "speaker", part.alias("part")).agg(pieces.alias("p")).select(
        "conv_id", "speaker", "part", F.array_join(F.col("p.segment"), "").alias("text"),
        F.get("p.start", F.lit(0)).alias("start"),
        F.transform(F.filter("p", lambda x: x["mask_length"] > 0),
                    lambda x: F.struct(x["mask_start"].alias("start"), x["mask_length"].alias("length"))).alias("masks"),
    )
