"""Job: the final deck of a recording, with what happened to every bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import final_slides as ops
from lectern.operators.intervals import stage1_video_ratio
from lectern.settings import has_hot_key


def final_slides(
    slide_map: DataFrame, runs: DataFrame, metrics: DataFrame, images: DataFrame, *,
    fps: float = 25.0, duplicate_threshold: float = 0.8, people: DataFrame | None = None, borders: DataFrame | None = None,
    full_images: Column | None = None, auto_source: bool = True, split: bool | None = None, **thresholds,
) -> tuple[DataFrame, DataFrame]:
    """Returns (final slides, filter manifest).

    Duplicates are merged before the first slide's text is erased.  ``people``
    and ``borders`` are the rollups of the sampled frames, by video or by video
    and event; with them every slide gets its source mode.  ``full_images``
    tells whether a slide has an image of the full frame (all have, if not given).

    ``slide_map`` is read several times: pass a written table, or the result of
    ``lectern.settings.staged``, rather than a long plan.
    """
    if split is None:
        split = has_hot_key(slide_map.select("video_id"), ["video_id"])
    ratios = stage1_video_ratio(slide_map, runs, fps)
    marked = ops.mark_folds(ops.label_rows(slide_map, metrics, ratios, **thresholds), split)
    targeted = ops.duplicate_targets(ops.fold_into_previous(marked), images, duplicate_threshold)
    final = ops.place_leading_text(ops.collapse_duplicates(targeted), split)
    if people is not None and borders is not None:
        seen = final.withColumn("has_full_image", full_images if full_images is not None else F.lit(True))
        for rollup in (people, borders):
            keys = [k for k in ("video_id", "event_id") if k in rollup.columns]
            seen = seen.join(rollup, keys, "left")
        final = ops.decide_source_mode(seen, auto_source)
    return final, ops.filter_manifest(marked, targeted)
