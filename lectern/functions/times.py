"""Times: whole milliseconds inside the engine, seconds at its edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: Column | int) -> Column:
    """Integer quotient of non-negative integers, exact for any bigint."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def to_ms(seconds: Column) -> Column:
    return F.bround(F.coalesce(seconds, F.lit(0.0)) * 1000).cast("bigint")


def to_seconds(ms: Column) -> Column:
    return F.round(ms / 1000.0, 3)


def _clock(ms: Column, mark: str) -> Column:
    t = F.greatest(ms, F.lit(0).cast("bigint"))
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d",
        idiv(t, 3_600_000),
        idiv(F.pmod(t, F.lit(3_600_000)), 60_000),
        idiv(F.pmod(t, F.lit(60_000)), 1000),
        F.pmod(t, F.lit(1000)).cast("bigint"),
    )


def timecode(ms: Column) -> Column:
    """``hh:mm:ss.mmm``."""
    return _clock(ms, ".")


def srt_time(ms: Column) -> Column:
    """``hh:mm:ss,mmm``."""
    return _clock(ms, ",")


def estimate_duration_ms(text: Column) -> Column:
    """Speaking time from words (2.8 per second) and characters (16 per second)."""
    words = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))
    ms = F.greatest(words * 1000 / 2.8, F.length(text) * 1000 / 16.0, F.lit(350.0))
    return F.bround(F.greatest(F.lit(200.0), F.least(F.lit(12000.0), ms))).cast("bigint")


def frame_interval(start_ms: Column, end_ms: Column, fps: Column) -> tuple[Column, Column]:
    """Closed 1-based frame range of a time range."""
    first = F.greatest(
        F.lit(1), F.floor(F.greatest(start_ms, F.lit(0)) * fps / 1000) + 1
    ).cast("bigint")
    last = F.greatest(first, F.ceil(F.greatest(start_ms, end_ms) * fps / 1000).cast("bigint"))
    return first, last


def sample_frames(first: Column, last: Column, count: int) -> Column:
    """Evenly spaced distinct frames of a range; the middle one when only one is wanted."""
    middle = F.array(F.greatest(F.lit(1), F.bround((first + last) / 2.0)).cast("bigint"))
    if count <= 1:
        return middle
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    spread = F.transform(
        steps,
        lambda i: F.greatest(
            F.lit(1), F.bround(first + i * (last - first) / float(count - 1))
        ).cast("bigint"),
    )
    return F.when(last <= first, middle).otherwise(F.array_sort(F.array_distinct(spread)))


def event_frame(first: Column, last: Column, settle: int, frame_count: Column | None) -> Column:
    """A frame a little after the start, inside the run and the recording."""
    frame = F.greatest(first, F.least(last, first + settle))
    if frame_count is None:
        return F.greatest(F.lit(1), frame).cast("bigint")
    inside = F.greatest(F.lit(1), F.least(frame_count, frame))
    return F.when(frame_count > 0, inside).otherwise(F.greatest(F.lit(1), frame)).cast("bigint")
