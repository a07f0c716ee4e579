"""Keep, merge and label the slides of the final deck."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.boxes import Box, outside_ratio
from lectern.operators.scan import OrderedScan
from lectern.operators.speculative import PIECE_ROWS, speculative_fold

MAP_ORDER = ["slide_start_ms", "slide_end_ms", "bucket_id"]


def decide_speaker_only(
    duration_ms: Column, edge_density: Column, laplacian_var: Column, video_ratio: Column, *,
    min_ratio: float = 0.75, soft_ratio: float = 0.40, max_edge: float = 0.011, max_laplacian: float = 80.0,
    max_duration_ms: int = 2500,
) -> tuple[Column, Column]:
    """Whether a slide only shows the speaker, and why."""
    low = F.coalesce((edge_density <= max_edge) & (laplacian_var <= max_laplacian), F.lit(False))
    reason = (
        F.when(video_ratio >= min_ratio, "stage1_video_ratio")
        .when((video_ratio >= soft_ratio) & low, "stage1_soft_ratio_plus_low_visual")
        .when(video_ratio.isNull() & low & (duration_ms <= max_duration_ms), "no_stage1_low_visual_short")
        .otherwise("keep")
    )
    return reason != "keep", reason


def label_rows(slide_map: DataFrame, metrics: DataFrame, ratios: DataFrame, **thresholds) -> DataFrame:
    """The slide map with the speaker-only decision of each row.

    ``metrics(video_id, event_id, edge_density, laplacian_var)``,
    ``ratios(video_id, bucket_id, stage1_video_ratio)``.
    """
    rows = slide_map.join(metrics, ["video_id", "event_id"], "left").join(
        ratios.select("video_id", "bucket_id", "stage1_video_ratio"), ["video_id", "bucket_id"], "left"
    )
    duration = F.greatest(F.lit(0).cast("bigint"), F.col("slide_end_ms") - F.col("slide_start_ms"))
    flag, reason = decide_speaker_only(
        duration, F.col("edge_density"), F.col("laplacian_var"), F.col("stage1_video_ratio"), **thresholds
    )
    real = ~F.col("is_no_slide") & (F.col("event_id") > 0)
    return rows.withColumns(
        {
            "duration_ms": duration,
            "is_speaker_only": F.when(real, flag).otherwise(F.lit(False)),
            "decision_reason": F.when(F.col("is_no_slide"), "no_slide_bucket").when(real, reason).otherwise("keep"),
        }
    )


def mark_folds(labelled: DataFrame, split: bool | None = None) -> DataFrame:
    """Group number of every row: how many kept rows there are up to it, and what happens to it."""
    kept = ~(F.col("is_no_slide") | F.col("is_speaker_only"))
    return (
        OrderedScan(labelled.withColumn("kept", kept), ["video_id"], MAP_ORDER)
        .running_sum("gid", F.col("kept").cast("bigint"))
        .last_value("__target", F.when(F.col("kept"), F.col("event_id")))
        .row_number("row_no")
        .apply(split)
        .withColumn(
            "action",
            F.when(F.col("kept"), "keep").when(F.col("gid") == 0, "leading_no_previous")
            .when(F.col("gid") == 1, "merged_to_thumbnail").otherwise("merged_to_previous"),
        )
        .withColumn("fold_target_event_id", F.when(~F.col("kept"), F.col("__target")))
        .drop("__target")
    )


def _texts(column: str) -> Column:
    """Non-empty texts of a group in row order, joined by blanks."""
    text = F.trim(F.coalesce(column, F.lit("")))
    parts = F.array_sort(F.collect_list(F.when(text != "", F.struct(F.col("row_no"), text.alias("t")))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), " ")


def _ids(column: str = "source_segment_ids") -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def fold_into_previous(marked: DataFrame) -> DataFrame:
    """One row per kept slide (gid >= 1) and one for what came before the first (gid 0)."""
    merged = ~F.col("kept")
    spoken = (F.trim(F.coalesce("text", F.lit(""))) != "") | (
        F.trim(F.coalesce("translated_text", F.lit(""))) != "")
    own = F.struct("event_id", "bucket_id", "slide_start_ms", F.col("target_language").alias("target_language"))
    return (
        marked.groupBy("video_id", "gid")
        .agg(
            F.max(F.when(F.col("kept"), own)).alias("o"),
            F.max("slide_end_ms").alias("slide_end_ms"),
            _texts("text").alias("text"), _texts("translated_text").alias("translated_text"),
            _ids().alias("source_segment_ids"),
            F.bool_or(merged & spoken).alias("received_text"),
        )
        .select("video_id", "gid", "o.*", "slide_end_ms", "text", "translated_text", "source_segment_ids",
                "received_text")
    )


def alike(a: np.ndarray | None, b: np.ndarray | None, threshold: float) -> bool:
    return a is not None and b is not None and len(a) == len(b) and float(np.mean(np.abs(a - b))) <= threshold


def duplicate_targets(
    folded: DataFrame, images: DataFrame, threshold: float = 0.8, piece_rows: int = PIECE_ROWS, split: bool | None = None,
) -> DataFrame:
    """Adds ``target_gid``: the slide a kept slide is merged into (itself when it stays).

    ``images(video_id, event_id, image)``; the comparison is always with the
    last slide that stayed. Only numbers and images enter the fold.
    """
    def step(last, _at, flags, image):
        gid = flags[0]
        if gid == 0:
            return last, 0
        if last[0] is not None and alike(image, last[0][1], threshold):
            return last, last[0][0]
        return [(gid, image)], gid

    pictured = folded.select("video_id", "event_id", "gid").join(images, ["video_id", "event_id"], "left")
    found = speculative_fold(pictured, ["video_id"], ["gid"], "image", ["gid"], step, 1, "target_gid", piece_rows, split)
    found = found.select(F.col("video_id").alias("__v"), F.col("gid").alias("__g"), "target_gid")
    return folded.join(found, F.col("video_id").eqNullSafe(F.col("__v")) & (F.col("gid") == F.col("__g"))).drop("__v", "__g")


def collapse_duplicates(targeted: DataFrame) -> DataFrame:
    """Merge text, ids and end of duplicates; the translated text of a duplicate is not carried over."""
    rows = targeted.withColumn("row_no", F.col("gid")).withColumn("__own", F.col("gid") == F.col("target_gid"))
    own = F.struct("event_id", "bucket_id", "slide_start_ms", "target_language", "translated_text", "received_text")
    return (
        rows.groupBy("video_id", F.col("target_gid").alias("gid"))
        .agg(F.max(F.when(F.col("__own"), own)).alias("o"), F.max("slide_end_ms").alias("slide_end_ms"),
             _texts("text").alias("text"), _ids().alias("source_segment_ids"))
        .select("video_id", "gid", "o.*", "slide_end_ms", "text", "source_segment_ids")
    )


def place_leading_text(slides: DataFrame, split: bool | None = None) -> DataFrame:
    """Leading text goes to the second slide; the first keeps text only if some was merged into it.

    ``slides`` holds the kept slides of each video and, as gid 0, what came
    before the first.  A video without any kept slide gets that as its only row.
    """
    empty_ids = F.array().cast("array<bigint>")
    lead_row = F.col("gid") == 0
    lead = F.when(lead_row, F.struct(F.col("text").alias("t"), F.col("translated_text").alias("tr"),
                                     F.col("source_segment_ids").alias("ids")))
    # only the second slide after it looks at the leading text: two steps back instead of a copy beside every row
    first = (
        OrderedScan(slides, ["video_id"], ["gid"])
        .running_sum("slide_index", (~lead_row).cast("bigint")).lag("__after", lead)
        .total("__kept", (~lead_row).cast("bigint")).apply(split)
    )
    numbered = OrderedScan(first, ["video_id"], ["gid"]).lag("__second", "__after").apply(split).withColumn("__lead", F.coalesce(lead, F.col("__second")))
    some = F.coalesce((F.col("__lead.t") != "") | (F.size("__lead.ids") > 0), F.lit(False))
    erased = (F.col("slide_index") == 1) & ~F.col("received_text")
    takes = (F.col("slide_index") == 2) & some

    def text(own: str, lead_text: str) -> Column:
        base = F.trim(F.when(erased & ~lead_row, F.lit("")).otherwise(F.coalesce(own, F.lit(""))))
        both = F.trim(F.concat_ws(" ", F.nullif(F.trim(lead_text), F.lit("")), F.nullif(base, F.lit(""))))
        return F.when(takes, both).otherwise(base)

    ids = F.when(erased & ~lead_row, empty_ids).when(
        takes, F.array_sort(F.array_union("source_segment_ids", F.col("__lead.ids")))
    ).otherwise(F.col("source_segment_ids"))
    zero = F.lit(0).cast("bigint")

    def unless_lead(name: str, value) -> Column:
        return F.when(lead_row, value).otherwise(F.col(name)).alias(name)

    return numbered.where(~lead_row | ((F.col("__kept") == 0) & some)).select(
        "video_id", "slide_index", unless_lead("event_id", zero), unless_lead("bucket_id", F.lit("no_slide_leading")),
        unless_lead("slide_start_ms", zero), unless_lead("slide_end_ms", zero), lead_row.alias("is_no_slide"),
        F.when(~lead_row, F.col("event_id")).alias("merge_target_event_id"),
        text("text", "__lead.t").alias("text"), text("translated_text", "__lead.tr").alias("translated_text"),
        unless_lead("target_language", F.lit("")), ids.alias("source_segment_ids"),
        F.size(ids).cast("bigint").alias("segments_count"),
    )


def filter_manifest(marked: DataFrame, targeted: DataFrame) -> DataFrame:
    """What happened to every bucket and why; duplicates override the first decision."""
    kept = targeted.where(F.col("gid") > 0).select("video_id", "gid", "target_gid", "event_id")
    # duplicates are found by one aggregation per target slide instead of a self join
    moved = (
        kept.groupBy("video_id", "target_gid")
        .agg(F.max(F.when(F.col("gid") == F.col("target_gid"), F.col("event_id"))).alias("dup_target"),
             F.collect_list(F.when(F.col("gid") != F.col("target_gid"), F.col("event_id"))).alias("es"))
        .select("video_id", F.explode("es").alias("event_id"), "dup_target")
    )
    dup = F.col("dup_target").isNotNull()
    return (
        marked.join(moved, ["video_id", "event_id"], "left")
        .select(
            "video_id", "event_id", "bucket_id", "slide_start_ms", "slide_end_ms", "duration_ms", "is_no_slide",
            "is_speaker_only",
            F.when(dup, F.lit("duplicate_slide")).otherwise(F.col("decision_reason")).alias("decision_reason"),
            F.when(dup, F.lit("merged_duplicate_slide")).otherwise(F.col("action")).alias("action"),
            F.when(dup, F.col("dup_target")).otherwise(F.col("fold_target_event_id")).alias("merge_target_event_id"),
            F.round("edge_density", 6).alias("edge_density"), F.round("laplacian_var", 3).alias("laplacian_var"),
            F.round("stage1_video_ratio", 4).alias("stage1_video_ratio"),
            F.length(F.trim(F.coalesce("text", F.lit("")))).cast("bigint").alias("text_len"),
        )
    )


def person_rollup(
    boxes: DataFrame, roi: Box, frame_w: int, frame_h: int, keys: list[str], *,
    min_area: float = 0.02, min_outside: float = 0.35,
) -> DataFrame:
    """People seen outside the slide region, over the sampled frames of a slide."""
    b = Box.of()
    hit = (
        (b.w > 0) & (b.h > 0) & (b.area >= min_area * frame_w * frame_h) & (outside_ratio(b, roi) >= min_outside)
    )
    per_frame = boxes.groupBy(*keys, "frame_no").agg(
        F.bool_or(hit).alias("found"), F.max(F.when(hit, F.col("weight_pct"))).alias("top"))
    zero = F.lit(0).cast("bigint")
    return per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_frames"), F.count_if("found").alias("person_detected_frames"),
        F.bool_or("found").alias("person_present"), F.coalesce(F.max("top").cast("bigint"), zero).alias("person_max_weight_pct"),
    )


def border_rollup(side_diffs: DataFrame, keys: list[str], *, threshold: float, min_sides: int = 2) -> DataFrame:
    """Whether the slide continues beyond its region: matched sides per frame, medians per side.

    ``side_diffs``: keys, frame_no, side in left/right/top/bottom, diff (null = side not measurable).
    """
    sides = ("left", "right", "top", "bottom")
    per_frame = side_diffs.groupBy(*keys, "frame_no").agg(
        F.count_if(F.col("diff") <= threshold).alias("matched"),
    )
    counts = per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_frames"),
        F.count_if(F.col("matched") >= max(1, min_sides)).alias("matched_frame_count"),
        F.bround(F.median("matched")).cast("bigint").alias("median_matched_sides"),
    )
    medians = side_diffs.groupBy(*keys).agg(
        *[F.round(F.median(F.when(F.col("side") == s, F.col("diff"))), 3).alias(f"side_diff_{s}") for s in sides]
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("sample_frames") / 2.0))
    return counts.join(medians, keys).withColumn("slide_extension_detected", F.col("matched_frame_count") >= need)


def decide_source_mode(rows: DataFrame, auto: bool = True) -> DataFrame:
    """Full frame or slide region, with reason and confidence in hundredths.

    ``rows``: slide_index, has_full_image and the columns of both rollups.
    """
    present = F.coalesce("person_present", F.lit(False))
    border = F.coalesce("slide_extension_detected", F.lit(False))
    sides = F.coalesce("median_matched_sides", F.lit(0).cast("bigint"))
    frames = F.coalesce("person_detected_frames", F.lit(0).cast("bigint"))
    samples = F.coalesce("sample_frames", F.lit(0).cast("bigint"))
    first = F.col("slide_index") == 1
    ladder = [
        (first, "full", "thumbnail_always_full", F.lit(100)),
        (F.lit(not auto), "slide", "auto_disabled", F.lit(0)),
        (~F.coalesce("has_full_image", F.lit(False)), "slide", "no_full_image", F.lit(0)),
        (samples <= 0, "slide", "no_sample_frames", F.lit(0)),
        (~present & border, "full", "person_absent_and_border_match",
         F.least(F.lit(99), 55 + 10 * F.least(F.lit(4), sides))),
        (present, "slide", "person_detected_outside_roi", F.least(F.lit(99), 40 + 10 * frames)),
        (~border, "slide", "border_match_insufficient",
         F.greatest(F.lit(0), F.least(F.lit(95), 20 + 8 * sides))),
    ]
    mode, reason, conf = F.lit("slide"), F.lit("default_slide"), F.lit(0).cast("bigint")
    for cond, m, r, c in reversed(ladder):
        mode = F.when(cond, F.lit(m)).otherwise(mode)
        reason = F.when(cond, F.lit(r)).otherwise(reason)
        conf = F.when(cond, c.cast("bigint")).otherwise(conf)
    return rows.withColumns({"source_mode": mode, "source_reason": reason, "source_confidence_pct": conf})
