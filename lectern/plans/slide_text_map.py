"""Flagship job: the words of a transcript mapped to the slides shown meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators.intervals import fill_buckets, map_overlaps, slide_intervals
from lectern.operators.segments import clamp_segments, clean_segments, media_duration
from lectern.operators.slide_text import assemble_text, attach_translations, latest_translations
from lectern.settings import has_hot_key


def slide_text_map(
    segments: DataFrame,
    changes: DataFrame,
    translations: DataFrame | None = None,
    probed: DataFrame | None = None,
    split: bool | None = None,
) -> DataFrame:
    """``segments(video_id, segment_id, start_ms, end_ms, text)`` and
    ``changes(video_id, event_id, time_ms)`` to one row per bucket.

    The hot-video check is made once, on the narrow inputs, and shared by all steps.
    """
    if split is None:
        split = has_hot_key(changes.select("video_id"), ["video_id"]) or has_hot_key(
            segments.select("video_id"), ["video_id"]
        )
    clean = clean_segments(segments)
    durations = media_duration(clean, changes, probed)
    buckets = fill_buckets(slide_intervals(changes, durations, split), split)
    usable = clamp_segments(clean, durations).drop("duration_ms")
    latest = None if translations is None else latest_translations(translations)
    overlaps = map_overlaps(attach_translations(usable, latest), buckets)
    return assemble_text(buckets, overlaps, split)
