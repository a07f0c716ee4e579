"""Text of each bucket from the shares of its segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.segments import apportion_words


def latest_translations(translations: DataFrame) -> DataFrame:
    """Last row per segment wins; rows without a usable id are skipped.

    ``translations``: video_id, pos, segment_id (any type), translated_text, target_language.
    """
    sid = F.col("segment_id").cast("string").try_cast("bigint")
    return (
        translations.withColumn("segment_id", sid)
        .where(F.col("segment_id").isNotNull())
        .groupBy("video_id", "segment_id")
        .agg(
            F.max_by(
                F.struct(
                    F.trim(F.coalesce("translated_text", F.lit(""))).alias("translated_text"),
                    F.trim(F.coalesce("target_language", F.lit(""))).alias("target_language"),
                ),
                F.col("pos"),
            ).alias("v")
        )
        .select("video_id", "segment_id", "v.*")
    )


def attach_translations(segments: DataFrame, translations: DataFrame | None) -> DataFrame:
    if translations is None:
        return segments.withColumns({"translated_text": F.lit(""), "target_language": F.lit("")})
    joined = segments.join(translations, ["video_id", "segment_id"], "left")
    return joined.withColumns(
        {
            "translated_text": F.coalesce("translated_text", F.lit("")),
            "target_language": F.coalesce("target_language", F.lit("")),
        }
    )


def assemble_text(buckets: DataFrame, overlaps: DataFrame, split: bool | None = None) -> DataFrame:
    """Buckets with the ordered text of their fragments; empty buckets stay.

    Buckets enter the same aggregation as rows without a segment, so keeping
    the empty ones needs no outer join.
    """
    parts = apportion_words(overlaps, "text", "__chunk", split)
    parts = apportion_words(parts, "translated_text", "__translated", split)
    piece = F.struct(
        "start_ms", "end_ms", "segment_id", F.col("__chunk").alias("chunk"),
        F.col("__translated").alias("translated"), F.col("target_language").alias("lang"),
    )
    part_rows = parts.select("video_id", "bucket_id", piece.alias("p"))
    bucket_cols = ["event_id", "slide_start_ms", "slide_end_ms", "is_no_slide", "merge_target_event_id"]
    bucket_rows = buckets.select("video_id", "bucket_id", F.struct(*bucket_cols).alias("b"))
    grouped = (
        bucket_rows.unionByName(part_rows, allowMissingColumns=True)
        .groupBy("video_id", "bucket_id")
        .agg(F.max("b").alias("b"), F.array_sort(F.collect_list("p")).alias("ps"))
    )
    ids = F.array_sort(F.array_distinct(F.transform("ps", lambda p: p["segment_id"])))

    def joined(field: str):
        texts = F.transform("ps", lambda p: p[field])
        return F.array_join(F.filter(texts, lambda t: t != ""), " ")

    by_id = F.array_sort(F.transform("ps", lambda p: F.struct(p["segment_id"], p["lang"].alias("lang"))))
    langs = F.filter(F.transform(by_id, lambda p: p["lang"]), lambda v: v != "")
    return grouped.select(
        "video_id", "bucket_id", "b.*",
        joined("chunk").alias("text"),
        joined("translated").alias("translated_text"),
        F.coalesce(F.try_element_at(langs, F.lit(1)), F.lit("")).alias("target_language"),
        F.size(ids).cast("bigint").alias("segments_count"),
        ids.alias("source_segment_ids"),
        F.size("ps").cast("bigint").alias("mapped_fragments"),
    )
