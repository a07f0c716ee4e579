"""Speech chunks and the alignment of segments to synthesized speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import punctuation_bonus_pct, similarity, token_count
from lectern.functions.times import idiv
from lectern.operators.grouped import with_group_values
from lectern.operators.scan import OrderedScan

CHUNK = ["video_id", "chunk_index"]


def speech_weight(text: Column) -> Column:
    """Words plus a bonus for a sentence end, in hundredths of a word."""
    one = F.lit(1).cast("bigint")
    return F.greatest(one, token_count(text)) * 100 + punctuation_bonus_pct(text)


def chunk_timeline(chunks: DataFrame, split: bool | None = None) -> DataFrame:
    """Start and end of each generated chunk; chunks that failed keep zero."""
    ok = F.col("status") == "generated"
    spoken = F.when(ok, F.col("duration_ms")).otherwise(F.lit(0).cast("bigint"))
    end = F.col("__end")
    return (
        OrderedScan(chunks, ["video_id"], ["chunk_index"]).running_sum("__end", spoken).apply(split)
        .withColumns({"start_ms": F.when(ok, end - F.col("duration_ms")).otherwise(F.lit(0)).cast("bigint"),
                      "end_ms": F.when(ok, end).otherwise(F.lit(0)).cast("bigint")})
        .drop("__end")
    )


def allocate_words(segments: DataFrame, keys: list[str] = CHUNK, split: bool | None = None) -> DataFrame:
    """Share ``total_words`` of a chunk among its segments by weight (largest remainder).

    Everybody with weight gets one word; what is left goes by whole shares and
    then to the largest remainders, the later segment first on ties.  ``words``
    is null when there are fewer words than segments.  Integer arithmetic only.
    """
    c = F.col
    positive = c("weight") > 0
    totals = with_group_values(
        segments, keys, {"__pos": F.count_if(positive), "__w": F.sum(F.when(positive, c("weight")))}, split)
    rest = F.greatest(F.lit(0).cast("bigint"), c("total_words") - c("__pos"))
    shared = totals.withColumn("__rest", rest).withColumns({
        "__add": F.when(positive, idiv(c("weight") * c("__rest"), c("__w"))).otherwise(F.lit(0).cast("bigint")),
        "__frac": F.when(positive, F.pmod(c("weight") * c("__rest"), c("__w"))).otherwise(F.lit(-1).cast("bigint")),
    })
    ranked = (
        OrderedScan(shared.withColumns({"__nf": -c("__frac"), "__no": -c("segment_id")}), keys, ["__nf", "__no"])
        .row_number("__k").total("__given", "__add").apply(split)
    )
    extra = F.when(positive & (c("__k") <= c("__rest") - c("__given")), 1).otherwise(0)
    none = (c("total_words") <= 0) | (c("__pos") == 0)
    words = (
        F.when(none, F.lit(0)).when(c("total_words") < c("__pos"), F.lit(None))
        .when(positive, 1 + c("__add") + extra).otherwise(F.lit(0)).cast("bigint")
    )
    return ranked.withColumn("words", words).drop(
        "__pos", "__w", "__rest", "__add", "__frac", "__nf", "__no", "__k", "__given")


def align_by_words(segments: DataFrame, words: DataFrame, split: bool | None = None) -> DataFrame:
    """Times of the slice of recognized words that each segment was given.

    ``segments`` with ``words`` counts; ``words``: video_id, chunk_index, word_no
    (from 1 in the chunk), start_ms, end_ms relative to the chunk.
    """
    sliced = OrderedScan(segments, CHUNK, ["segment_id"]).running_sum("__upto", "words").apply(split)
    first = words.select(*CHUNK, F.col("word_no").alias("__first"), F.col("start_ms").alias("__ls"))
    last = words.select(*CHUNK, F.col("word_no").alias("__upto"), F.col("end_ms").alias("__le"))
    some = F.col("words") > 0
    zero = F.lit(0).cast("bigint")
    start = F.when(some, F.coalesce("__ls", zero)).otherwise(zero)
    end = F.when(some, F.coalesce("__le", zero)).otherwise(zero)
    return (
        sliced.withColumn("__first", F.col("__upto") - F.col("words") + 1)
        .join(first, [*CHUNK, "__first"], "left").join(last, [*CHUNK, "__upto"], "left")
        .withColumns({"tts_start_ms": F.col("chunk_start_ms") + start,
                      "tts_end_ms": F.col("chunk_start_ms") + F.greatest(start, end)})
        .drop("__first", "__upto", "__ls", "__le")
    )


def align_proportionally(segments: DataFrame, split: bool | None = None) -> DataFrame:
    """Share the time of a chunk by weight; the last segment ends with the chunk."""
    scanned = (
        OrderedScan(segments, CHUNK, ["segment_id"]).running_sum("__cum", "weight").total("__all", "weight").apply(split)
    )
    span = F.greatest(F.lit(0).cast("bigint"), F.col("chunk_end_ms") - F.col("chunk_start_ms"))

    def at(cum: Column) -> Column:
        return F.col("chunk_start_ms") + F.bround(span * cum / F.col("__all")).cast("bigint")

    return scanned.withColumns(
        {"tts_start_ms": at(F.col("__cum") - F.col("weight")), "tts_end_ms": at(F.col("__cum"))}).drop("__cum", "__all")


def choose_alignment(segments: DataFrame, words: DataFrame, min_similarity: float = 0.55, split: bool | None = None) -> DataFrame:
    """Word timing where the recognized text is close enough and has enough words, else proportional.

    ``segments``: video_id, chunk_index, segment_id, tts_text, chunk_start_ms,
    chunk_end_ms, chunk_text, asr_text.
    """
    chunk_words = words.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("total_words"))
    texts = segments.select("chunk_text", "asr_text").distinct().withColumn(
        "similarity", similarity(F.col("chunk_text"), F.col("asr_text")))
    rows = (
        segments.withColumn("weight", speech_weight(F.col("tts_text")))
        .join(chunk_words, CHUNK, "left").join(texts, ["chunk_text", "asr_text"])
        .withColumn("total_words", F.coalesce("total_words", F.lit(0).cast("bigint")))
    )
    both = align_proportionally(allocate_words(rows, CHUNK, split), split).withColumnsRenamed(
        {"tts_start_ms": "__ps", "tts_end_ms": "__pe"})
    timed = align_by_words(both, words, split)
    by_words = (F.col("total_words") > 0) & (F.col("similarity") >= min_similarity) & F.col("words").isNotNull()
    return timed.select(
        *CHUNK, "segment_id",
        F.when(by_words, F.col("tts_start_ms")).otherwise(F.col("__ps")).alias("tts_start_ms"),
        F.when(by_words, F.col("tts_end_ms")).otherwise(F.col("__pe")).alias("tts_end_ms"),
        F.when(by_words, "asr_word_count").otherwise("proportional").alias("alignment_mode"),
        F.round(F.when(by_words, F.col("similarity")).otherwise(F.least(F.col("similarity"), F.lit(0.5))), 4).alias("confidence"),
    )
