"""Transcript segments: cleaning, clamping, stitching, durations, word shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.functions.times import estimate_duration_ms
from lectern.operators.folding import fold_columns
from lectern.operators.scan import OrderedScan

SEGMENT_ORDER = ["start_ms", "end_ms", "segment_id"]


def clean_segments(segments: DataFrame) -> DataFrame:
    """Whitespace collapsed, empty texts dropped, end never before start."""
    return (
        segments.withColumn("text", collapse(F.coalesce("text", F.lit(""))))
        .where(F.col("text") != "")
        .withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    )


def clamp_segments(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Times forced into the recording; segments without extent dropped.

    ``durations(video_id, duration_ms)``; an unknown or zero duration does not clamp.
    """
    d = F.coalesce(F.col("duration_ms"), F.lit(0))

    def inside(t: Column) -> Column:
        return F.when(d > 0, F.least(t, d)).otherwise(t)

    start = F.greatest(F.lit(0).cast("bigint"), F.col("start_ms"))
    end = F.greatest(start, F.col("end_ms"))
    return (
        segments.join(durations.select("video_id", "duration_ms"), "video_id", "left")
        .withColumns({"start_ms": inside(start), "end_ms": inside(end)})
        .drop("duration_ms")
        .where(F.col("end_ms") > F.col("start_ms"))
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    )


def media_duration(segments: DataFrame, changes: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """Longest of the probed duration, the last segment end and the last slide change."""
    ends = [
        segments.select("video_id", F.col("end_ms").alias("t")),
        changes.select("video_id", F.col("time_ms").alias("t")),
    ]
    if probed is not None:
        ends.append(probed.select("video_id", F.col("duration_ms").alias("t")))
    rows = ends[0]
    for other in ends[1:]:
        rows = rows.unionByName(other)
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("video_id").agg(
        F.greatest(F.max("t"), zero).alias("duration_ms")
    )


def transcript_span(segments: DataFrame) -> DataFrame:
    """Last end minus first start per video."""
    return segments.groupBy("video_id").agg(
        F.greatest(F.max("end_ms") - F.min("start_ms"), F.lit(0).cast("bigint")).alias("span_ms")
    )


def apportion_words(overlaps: DataFrame, text: str, out: str, split: bool | None = None) -> DataFrame:
    """Share the words of ``text`` among the overlaps of a segment by their length.

    ``overlaps`` has one row per (video, segment, bucket) with ``overlap_ms`` and
    ``bucket_start_ms``.  Cut points are the half-even roundings of the running
    share; when there are fewer words than parts the longest part (first on
    ties) takes the whole text.
    """
    keys = ["video_id", "segment_id"]
    scanned = (
        OrderedScan(overlaps, keys, ["bucket_start_ms"])
        .running_sum("__cum", "overlap_ms")
        .total("__total", "overlap_ms")
        .total("__parts", F.lit(1))
        .row_number("__at")
        .max_before("__before", "overlap_ms")
        .whole_max("__longest", "overlap_ms")
        .apply(split)
    )
    # columns of their own: the value below names them many times, and each would clean the text anew
    scanned = scanned.withColumn("__clean", collapse(F.coalesce(F.col(text), F.lit("")))).withColumn("__words", F.split("__clean", " "))
    clean, words = F.col("__clean"), F.col("__words")
    n = F.size(words)
    total = F.col("__total")

    def cut(cum: Column) -> Column:
        return F.least(n, F.bround(cum / total * n).cast("int"))

    start = cut(F.col("__cum") - F.col("overlap_ms"))
    end = F.when(F.col("__at") == F.col("__parts"), n).otherwise(cut(F.col("__cum")))
    share = F.array_join(F.slice(words, start + 1, F.greatest(end - start, F.lit(0))), " ")
    is_longest = (F.col("overlap_ms") == F.col("__longest")) & F.coalesce(
        F.col("__before") < F.col("__longest"), F.lit(True)
    )
    value = (
        F.when(clean == "", F.lit(""))
        .when(F.col("__parts") == 1, clean)
        .when(n < F.col("__parts"), F.when(is_longest, clean).otherwise(F.lit("")))
        .otherwise(share)
    )
    return scanned.withColumn(out, value).drop(
        "__cum", "__total", "__parts", "__at", "__before", "__longest", "__clean", "__words"
    )


def audio_ranges(recordings: DataFrame, chunk_ms: int = 55_000, overlap_ms: int = 750) -> DataFrame:
    """Overlapping ranges over ``(video_id, total_frames, sample_rate)``; the last one is cut short."""
    rate = F.col("sample_rate")
    size = F.greatest(F.lit(1), F.bround(chunk_ms / 1000.0 * rate)).cast("bigint")
    back = F.greatest(F.lit(0), F.bround(overlap_ms / 1000.0 * rate)).cast("bigint")
    back = F.when(back >= size, F.greatest(F.lit(0).cast("bigint"), size - 1)).otherwise(back)
    step = F.greatest(F.lit(1).cast("bigint"), size - back)
    # the range that first reaches the end is the last one
    count = F.greatest(
        F.lit(1), F.ceil((F.col("total_frames") - size) / step) + 1
    ).cast("bigint")
    return (
        recordings.where(F.col("total_frames") > 0)
        .withColumns({"__size": size, "__step": step})
        .withColumn("range_no", F.explode(F.sequence(F.lit(1).cast("bigint"), count)))
        .select(
            "video_id",
            "range_no",
            ((F.col("range_no") - 1) * F.col("__step")).alias("start_frame"),
            F.least(
                F.col("total_frames"), (F.col("range_no") - 1) * F.col("__step") + F.col("__size")
            ).alias("end_frame"),
        )
    )


class _Reach:
    """Ends of the results of one chunk: a missing end is guessed behind the furthest end so far."""

    def __init__(self) -> None:
        self.reach = 0

    def __call__(self, offset, chunk_ms, before_rest, estimate):
        begin = self.reach
        if offset <= begin + 1:
            offset = min(begin + estimate, max(begin + 150, before_rest))
        stop = min(chunk_ms, max(offset, begin + 1))
        self.reach = max(begin, stop)
        return begin, stop


class _News:
    """Of ranges in order, those that reach more than 50 ms past all taken before; cut to what is new."""

    def __init__(self) -> None:
        self.heard = self.taken = 0

    def __call__(self, low, high, limit):
        fresh, stop = min(max(low, self.heard), limit), min(high, limit)
        if high - self.heard <= 50 or stop - fresh <= 1:
            return None, None, None
        self.heard, self.taken = max(self.heard, stop), self.taken + 1
        return self.taken, fresh, stop


def stitch_overlaps(results: DataFrame, split: bool | None = None) -> DataFrame:
    """Join the results of overlapping recognition chunks into one transcript.

    ``results``: video_id, chunk_no, result_no, chunk_start_ms, chunk_ms,
    duration_ms (0 = unknown), end_offset_ms (0 = missing), text.  Ends depend
    on their own chunk alone and are found chunk by chunk; only three numbers of
    a result go through the order of the whole video.
    """
    place = ["video_id", "chunk_no", "result_no"]
    texts = results.withColumn("text", collapse(F.coalesce("text", F.lit("")))).where(F.col("text") != "")
    counted = (
        OrderedScan(
            texts.select(*place, "chunk_start_ms", "chunk_ms", "duration_ms",
                         F.coalesce("end_offset_ms", F.lit(0)).cast("bigint").alias("end_offset_ms"),
                         estimate_duration_ms(F.col("text")).alias("estimate_ms")),
            place[:2], place[2:])
        .row_number("__n")
        .total("__all", F.lit(1))
        .apply(split)
        .withColumn("before_rest", F.col("chunk_ms") - 150 * (F.col("__all") - F.col("__n")))
    )
    ended = fold_columns(
        counted, place[:2], place[2:], _Reach, ["end_offset_ms", "chunk_ms", "before_rest", "estimate_ms"],
        {"__from": "bigint", "__to": "bigint"})
    forever = F.lit((1 << 63) - 1)
    ranges = ended.select(
        *place, (F.col("chunk_start_ms") + F.col("__from")).alias("low"), (F.col("chunk_start_ms") + F.col("__to")).alias("high"),
        F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(forever).alias("limit"))
    news = fold_columns(
        ranges, place[:1], place[1:], _News, ["low", "high", "limit"],
        {"segment_id": "bigint", "start_ms": "bigint", "end_ms": "bigint"})
    return news.where(F.col("segment_id").isNotNull()).join(texts.select(*place, "text"), place).select(
        "video_id", "segment_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "text")
