"""Job: slide-change events from frame runs, transitions and frame differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.times import event_frame
from lectern.operators import changes as ops
from lectern.settings import has_hot_key


def candidates(
    runs: DataFrame, transitions: DataFrame, diffs: DataFrame, *,
    settle: int = 3, blend_max: int = 40, backfill_min: int = 12, threshold_milli: int = 120,
    end_guard: int = 2, lookahead: int = 2, split: bool | None = None, media: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """Primary candidates (first slide run, transitions) and late ones for uncovered runs.

    With ``media(video_id, frame_count)``, one row a video, no event lies
    behind the end of its video. ``parts`` is the number of partitions that
    ``runs`` are dealt into by video, if they are.
    """
    if split is None:
        split = has_hot_key(runs.select("video_id"), ["video_id"])
    if split:
        rows = _joined_candidates(
            runs, transitions, diffs, settle=settle, blend_max=blend_max, backfill_min=backfill_min, threshold_milli=threshold_milli,
            end_guard=end_guard, lookahead=lookahead)
        return ops.keep_uncovered(rows if media is None else _ended(rows, media), split)
    short = runs.where((F.col("slide_id") < 0) & (F.col("f1") - F.col("f0") + 1 <= blend_max))
    motion = ops.short_run_motion(short, diffs, threshold_milli, end_guard, lookahead)
    if parts is not None:
        motion = motion.repartition(parts, "video_id")
    rows = ops.targeted(runs, transitions, motion, settle=settle, blend_max=blend_max, backfill_min=backfill_min)
    if media is None:
        return ops.keep_uncovered(rows, split)
    return _clamped(ops.keep_uncovered_ended(rows, media)).select(*rows.columns)


def _clamped(rows: DataFrame) -> DataFrame:
    inside = F.when(F.col("__frames") > 0, F.least(F.col("__frames"), F.col("event_frame"))).otherwise(F.col("event_frame"))
    return rows.withColumn("event_frame", F.greatest(F.lit(1), inside).cast("bigint"))


def _ended(rows: DataFrame, media: DataFrame) -> DataFrame:
    counts = media.select(F.col("video_id").alias("__video"), F.col("frame_count").alias("__frames"))
    return _clamped(rows.join(counts, F.col("video_id").eqNullSafe(F.col("__video")), "left")).select(*rows.columns)


def _joined_candidates(
    runs: DataFrame, transitions: DataFrame, diffs: DataFrame, *,
    settle: int, blend_max: int, backfill_min: int, threshold_milli: int, end_guard: int, lookahead: int,
) -> DataFrame:
    """The rows of ``targeted`` where a video is too large for one task."""
    split = True
    initial = ops.initial_events(runs)
    short = runs.where((F.col("slide_id") < 0) & (F.col("f1") - F.col("f0") + 1 <= blend_max))
    stable = ops.longest_stable_run(short, diffs, "seg_idx", threshold_milli, split=split)
    default = event_frame(F.col("f0"), F.col("f1"), settle, None)
    still = ops.pick_stable_frame(
        short.withColumn("__default", default), diffs, "seg_idx", "__default", end_guard, lookahead
    ).select("video_id", F.col("seg_idx").alias("target_seg_idx"), "stable_frame")

    matched = ops.match_boundaries(transitions, runs, split)
    targets = ops.suppress_repeats(ops.blend_targets(matched, runs, stable, blend_max, split), initial, split)
    is_short_video = (F.col("slide_id") < 0) & (F.col("f1") - F.col("f0") + 1 <= blend_max)
    frame = (
        F.when(F.col("target_seg_idx").isNull(), F.greatest(F.lit(1), F.col("frame_id_1") + settle))
        .when(is_short_video & F.col("keep_short"), F.greatest(F.lit(1), F.coalesce("stable_frame", default)))
        .otherwise(default)
    )
    from_transitions = targets.join(still, ["video_id", "target_seg_idx"], "left").select(
        "video_id", frame.cast("bigint").alias("event_frame"), F.lit(0).alias("sort_priority"), "frame_id_0", "frame_id_1",
        "transition_no", F.coalesce(F.col("slide_id") >= 0, F.lit(True)).alias("updates_slide_state"),
        F.when(F.col("slide_id") >= 0, F.col("target_seg_idx")).alias("seg_idx"),
    )

    def from_run(df: DataFrame, priority: int) -> DataFrame:
        return df.select(
            "video_id", default.alias("event_frame"), F.lit(priority).alias("sort_priority"),
            F.col("f0").alias("frame_id_0"), F.col("f1").alias("frame_id_1"),
            F.lit(0).cast("bigint").alias("transition_no"), F.lit(True).alias("updates_slide_state"), "seg_idx",
        )

    primary = from_run(initial, 0).unionByName(from_transitions)
    late = from_run(ops.long_slide_runs(runs, backfill_min), 1)
    return primary.unionByName(late)


def slide_changes(
    runs: DataFrame, transitions: DataFrame, diffs: DataFrame, patches: DataFrame | None = None, *,
    fps_milli: int = 25_000, dedupe_threshold: float = 0.0, media: DataFrame | None = None, split: bool | None = None, **options,
) -> DataFrame:
    """Numbered slide changes; with ``media(video_id, frame_count)`` no event lies behind the end of its video."""
    if split is None:
        split = has_hot_key(runs.select("video_id"), ["video_id"])
    rows = candidates(runs, transitions, diffs, split=split, media=media, **options)
    if patches is not None:
        rows = ops.dedupe_backfills(rows, patches, dedupe_threshold, split=split)
    return ops.number_events(rows, fps_milli, split)
