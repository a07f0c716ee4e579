"""Interval joins and the bucket timeline of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import numbered
from lectern.functions.times import frame_interval, idiv
from lectern.operators.scan import OrderedScan

#: one minute of recording / about two minutes of frames
TIME_BIN_MS = 60_000
FRAME_BIN = 4_096


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    bin_size: int,
) -> DataFrame:
    """Pairs of half-open ranges of the same key that overlap.

    Both sides are laid into fixed bins and joined on (key, bin), so the work
    of a long video is spread over its bins; a pair that shares several bins is
    kept only in the first of them, which needs no de-duplication shuffle.
    """
    (ls, le), (rs, re) = left_range, right_range

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        bins = F.sequence(idiv(F.col(s), bin_size), idiv(F.col(e) - 1, bin_size))
        return df.where(F.col(e) > F.col(s)).withColumn("__bin", F.explode(bins))

    a = binned(left, ls, le)
    b = binned(right, rs, re).withColumnRenamed(key, "__key")
    first_shared = F.greatest(idiv(F.col(ls), bin_size), idiv(F.col(rs), bin_size))
    return (
        a.join(
            b.withColumnRenamed("__bin", "__bin_r"),
            (F.col(key) == F.col("__key"))
            & (F.col("__bin") == F.col("__bin_r"))
            & (F.col(ls) < F.col(re))
            & (F.col(rs) < F.col(le))
            & (F.col("__bin") == first_shared),
        )
        .drop("__key", "__bin", "__bin_r")
    )


def slide_intervals(changes: DataFrame, durations: DataFrame, split: bool | None = None) -> DataFrame:
    """Each slide lasts until the next change; the last one until the end.

    Videos known only from ``durations`` stay as one row without an event.
    """
    rows = changes.select("video_id", "event_id", "time_ms")
    ends = durations.select("video_id", "duration_ms")
    # changes are the left side of the join, the side that AQE may split when skewed
    with_end = rows.join(ends, "video_id").unionByName(
        ends.join(rows.select("video_id").distinct(), "video_id", "left_anti"),
        allowMissingColumns=True,
    )
    scanned = (
        OrderedScan(with_end, ["video_id"], ["time_ms", "event_id"])
        .lead("__next", "time_ms")
        .apply(split)
    )
    zero = F.lit(0).cast("bigint")
    d = F.col("duration_ms")

    def inside(t):
        return F.when(d > 0, F.least(t, d)).otherwise(t)

    start = inside(F.greatest(F.coalesce("time_ms", zero), zero))
    end = F.when(F.col("event_id").isNull(), zero).otherwise(
        inside(F.greatest(F.col("start_ms"), F.coalesce("__next", d)))
    )
    return (
        scanned.withColumn("start_ms", start)
        .withColumn("end_ms", end)
        .select("video_id", "event_id", "time_ms", "start_ms", "end_ms", "duration_ms")
    )


def fill_buckets(intervals: DataFrame, split: bool | None = None) -> DataFrame:
    """Slide buckets trimmed to what is still free, and ``no_slide`` buckets for the gaps.

    The loop's cursor is the running maximum of the ends seen before, so the
    whole operator is two scans over the same partitioning.
    """
    order = ["time_ms", "event_id"]
    zero = F.lit(0).cast("bigint")
    cursor = (
        OrderedScan(intervals, ["video_id"], order)
        .max_before("__cursor", "end_ms")
        .lead("__more", F.lit(1))
        .apply(split)
        .withColumn("__cursor", F.coalesce("__cursor", zero))
        .withColumn("__from", F.greatest("start_ms", "__cursor"))
        .withColumn("__kept", F.col("event_id").isNotNull() & (F.col("end_ms") > F.col("__from")))
        .withColumn("__gap", F.col("event_id").isNotNull() & (F.col("start_ms") > F.col("__cursor")))
    )
    known = (
        OrderedScan(cursor, ["video_id"], order)
        .last_before("__before", F.when(F.col("__kept"), F.col("event_id")))
        .running_sum("__gaps", F.col("__gap").cast("bigint"))
        .apply(split)
    )
    null_id = F.lit(None).cast("bigint")
    reach = F.greatest("__cursor", "end_ms")

    def bucket(event, kind, start, end, gap_no, target):
        return F.struct(
            event.alias("event_id"), start.alias("slide_start_ms"), end.alias("slide_end_ms"),
            F.lit(kind).alias("is_no_slide"), gap_no.alias("gap_no"), target.alias("merge_target_event_id"),
        )

    parts = F.array_compact(
        F.array(
            F.when(
                F.col("__gap"),
                bucket(zero, True, F.col("__cursor"), F.col("start_ms"), F.col("__gaps"), F.col("__before")),
            ),
            F.when(
                F.col("__kept"),
                bucket(F.col("event_id"), False, F.col("__from"), F.col("end_ms"), null_id, F.col("event_id")),
            ),
            F.when(
                F.col("__more").isNull() & (F.col("duration_ms") > reach),
                bucket(
                    zero, True, reach, F.col("duration_ms"), F.col("__gaps") + 1,
                    F.coalesce(F.when(F.col("__kept"), F.col("event_id")), F.col("__before")),
                ),
            ),
        )
    )
    rows = known.select("video_id", F.explode(parts).alias("b")).select("video_id", "b.*")
    name = F.when(F.col("is_no_slide"), numbered("no_slide_", F.col("gap_no"))).otherwise(
        numbered("event_", F.col("event_id"))
    )
    return rows.select(
        "video_id", name.alias("bucket_id"), "event_id", "slide_start_ms", "slide_end_ms",
        "is_no_slide", "merge_target_event_id",
    )


def map_overlaps(segments: DataFrame, buckets: DataFrame, bin_ms: int = TIME_BIN_MS) -> DataFrame:
    """One row per segment and bucket that share time; touching ranges do not."""
    b = buckets.select(
        "video_id", "bucket_id",
        F.col("slide_start_ms").alias("bucket_start_ms"), F.col("slide_end_ms").alias("bucket_end_ms"),
    )
    return overlap_join(
        segments, b, "video_id", ("start_ms", "end_ms"), ("bucket_start_ms", "bucket_end_ms"), bin_ms
    ).withColumn(
        "overlap_ms",
        F.least("end_ms", "bucket_end_ms") - F.greatest("start_ms", "bucket_start_ms"),
    )


def stage1_video_ratio(
    events: DataFrame, runs: DataFrame, fps: float = 25.0, bin_frames: int = FRAME_BIN
) -> DataFrame:
    """Share of a bucket's frames inside runs without a slide; null for videos without any runs.

    ``events``: video_id, bucket_id, slide_start_ms, slide_end_ms;
    ``runs``: video_id, slide_id, f0, f1 (closed frame ranges).
    """
    first, last = frame_interval(F.col("slide_start_ms"), F.col("slide_end_ms"), F.lit(fps))
    framed = events.select("video_id", "bucket_id", first.alias("s"), last.alias("e"))
    known = runs.select("video_id").distinct().withColumn("__has_runs", F.lit(True))
    hits = (
        overlap_join(
            framed.withColumn("e1", F.col("e") + 1),
            runs.where(F.col("slide_id") < 0).select("video_id", "f0", (F.col("f1") + 1).alias("f2")),
            "video_id", ("s", "e1"), ("f0", "f2"), bin_frames,
        )
        .groupBy("video_id", "bucket_id")
        .agg(F.sum(F.least("e1", "f2") - F.greatest("s", "f0")).alias("video_frames"))
    )
    return (
        framed.join(known, "video_id", "left")
        .join(hits, ["video_id", "bucket_id"], "left")
        .select(
            "video_id", "bucket_id",
            F.when(F.col("__has_runs"), F.coalesce("video_frames", F.lit(0).cast("bigint"))).alias("video_frames"),
            F.greatest(F.lit(1), F.col("e") - F.col("s") + 1).cast("bigint").alias("total_frames"),
        )
        .withColumn("stage1_video_ratio", F.col("video_frames") / F.col("total_frames"))
    )
