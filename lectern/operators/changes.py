"""Slide changes from frame runs and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.times import event_frame, timecode
from lectern.operators.final_slides import alike
from lectern.operators.grouped import looked_up, with_group_values
from lectern.operators.intervals import FRAME_BIN, overlap_join
from lectern.operators.scan import OrderedScan
from lectern.operators.speculative import PIECE_ROWS, speculative_fold

CANDIDATE_ORDER = ["event_frame", "sort_priority", "frame_id_0", "frame_id_1", "transition_no"]


def match_boundaries(transitions: DataFrame, runs: DataFrame, split: bool | None = None) -> DataFrame:
    """The run that starts at a transition, by (end before + 1, start after + 1); the later run wins."""
    edges = (
        OrderedScan(runs, ["video_id"], ["seg_idx"]).lag("__prev", "f1").apply(split)
        .where(F.col("__prev").isNotNull())
        .groupBy("video_id", (F.col("__prev") + 1).alias("frame_id_0"), (F.col("f0") + 1).alias("frame_id_1"))
        .agg(F.max("seg_idx").alias("target_seg_idx"))
    )
    return transitions.join(edges, ["video_id", "frame_id_0", "frame_id_1"], "left")


def initial_events(runs: DataFrame) -> DataFrame:
    """The first run with a slide of every video."""
    return (
        runs.where(F.col("slide_id") >= 0)
        .groupBy("video_id")
        .agg(F.min_by(F.struct("seg_idx", "f0", "f1"), F.col("seg_idx")).alias("r"))
        .select("video_id", "r.*")
    )


def run_frame_diffs(runs: DataFrame, diffs: DataFrame, bin_frames: int = FRAME_BIN) -> DataFrame:
    """Differences of the frames of each run against the frame before, first frame excluded."""
    r = runs.withColumns({"__a": F.col("f0") + 1, "__b": F.col("f1") + 1})
    d = diffs.select("video_id", "frame_id", (F.col("frame_id") + 1).alias("__f2"), "diff_milli")
    return overlap_join(r, d, "video_id", ("__a", "__b"), ("frame_id", "__f2"), bin_frames).drop(
        "__a", "__b", "__f2"
    )


def longest_stable_run(
    runs: DataFrame, diffs: DataFrame, run_key: str, threshold_milli: int = 120, min_frames: int = 6,
    split: bool | None = None,
) -> DataFrame:
    """Most consecutive frames without a visible change, per run."""
    keys = ["video_id", run_key]
    rows = run_frame_diffs(runs.select("video_id", run_key, "f0", "f1"), diffs)
    low = F.col("diff_milli") <= threshold_milli
    islands = (
        OrderedScan(rows, keys, ["frame_id"]).running_sum("__island", (~low).cast("bigint")).apply(split)
        .groupBy(*keys, "__island").agg(F.sum(low.cast("bigint")).alias("n"))
        .groupBy(*keys).agg((F.max("n") + 1).alias("n"))
    )
    length = F.col("f1") - F.col("f0") + 1
    best = F.coalesce("n", F.lit(1).cast("bigint"))
    return (
        runs.select("video_id", run_key, "f0", "f1").join(islands, keys, "left")
        .select(*keys, best.alias("longest_run"),
                ((length >= min_frames) & (best >= min_frames)).alias("has_stable_part"))
    )


def pick_stable_frame(
    runs: DataFrame, diffs: DataFrame, run_key: str, default: str,
    end_guard: int = 2, lookahead: int = 2,
) -> DataFrame:
    """Frame with the least motion now and just after it, for short runs.

    score = max(next ``lookahead`` differences) + half the own one, kept as the
    doubled integer; earliest frame on ties.  A short run has at most a few
    dozen frames, so its window is bounded by definition.
    """
    keys = ["video_id", run_key]
    rows = run_frame_diffs(runs.select("video_id", run_key, "f0", "f1"), diffs)
    w = Window.partitionBy(*keys).orderBy("frame_id").rangeBetween(1, lookahead)
    scored = rows.withColumn("__ahead", F.max("diff_milli").over(w)).where(
        F.col("__ahead").isNotNull() & (F.col("frame_id") <= F.col("f1") - end_guard)
    )
    best = scored.groupBy(*keys).agg(
        F.min_by("frame_id", F.struct(2 * F.col("__ahead") + F.col("diff_milli"), F.col("frame_id"))).alias("__best")
    )
    fallback = F.greatest("f0", F.least("f1", default))
    return (
        runs.join(best, keys, "left")
        .withColumn("stable_frame", F.when(F.col("f1") <= F.col("f0"), fallback).otherwise(
            F.coalesce("__best", fallback)))
        .drop("__best")
    )


def short_run_motion(
    runs: DataFrame, diffs: DataFrame, threshold_milli: int = 120, end_guard: int = 2, lookahead: int = 2
) -> DataFrame:
    """``longest_run`` and the frame with the least motion of the short runs that have differences, from one interval join.

    The values are those of ``longest_stable_run`` and ``pick_stable_frame``; a
    short run has at most a few dozen frames, so its window is bounded.
    """
    keys = ["video_id", "seg_idx"]
    w = Window.partitionBy(*keys).orderBy("frame_id")
    low = F.col("diff_milli") <= threshold_milli
    rows = run_frame_diffs(runs.select(*keys, "f0", "f1"), diffs).withColumns({
        "__ahead": F.max("diff_milli").over(w.rangeBetween(1, lookahead)),
        "__island": F.sum((~low).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    scored = F.col("__ahead").isNotNull() & (F.col("frame_id") <= F.col("f1") - end_guard)
    score = F.struct((2 * F.col("__ahead") + F.col("diff_milli")).alias("score"), "frame_id")
    return (
        rows.groupBy(*keys, "__island").agg(F.sum(low.cast("bigint")).alias("n"), F.min(F.when(scored, score)).alias("best"))
        .groupBy(*keys).agg((F.max("n") + 1).alias("longest_run"), F.min("best")["frame_id"].alias("still_frame"))
    )


def targeted(
    runs: DataFrame, transitions: DataFrame, motion: DataFrame, *, settle: int = 3, blend_max: int = 40, backfill_min: int = 12,
    min_frames: int = 6,
) -> DataFrame:
    """Candidates of ordinary videos before late ones are left out: first slide runs, transitions, long slide runs.

    The rows of ``match_boundaries``, ``blend_targets``, ``suppress_repeats``,
    ``initial_events`` and ``long_slide_runs``, by windows that all keep to the
    partitions of a video. ``motion`` is what ``short_run_motion`` gives. A run
    is looked up by the transitions and is a candidate itself in the same pass,
    so the runs are computed once.
    """
    length = F.col("f1") - F.col("f0") + 1
    slide, short = F.col("slide_id") >= 0, (F.col("slide_id") < 0) & (length <= blend_max)
    default = event_frame(F.col("f0"), F.col("f1"), settle, None)
    held = looked_up(runs.select("video_id", "seg_idx", "slide_id", "f0", "f1"), motion, ["video_id", "seg_idx"], ["longest_run", "still_frame"], "left")
    around = (
        OrderedScan(held, ["video_id"], ["seg_idx"]).lag("__prev", "f1")
        .lead("__next", F.struct("seg_idx", (F.col("slide_id") >= 0).alias("slide"), default.alias("frame")))
        .max_before("__shown", slide.cast("int")).apply(False)
    )
    # a short run of moving video without a stable part hands its transition to the next slide run
    stable = (length >= min_frames) & (F.coalesce("longest_run", F.lit(1).cast("bigint")) >= min_frames)
    stable = F.coalesce(short & stable, F.lit(False))
    moves = F.coalesce(short & ~stable & F.col("__next.slide"), F.lit(False))
    inside = F.greatest("f0", F.least("f1", default))
    still = F.greatest(F.lit(1), F.when(F.col("f1") <= F.col("f0"), inside).otherwise(F.coalesce("still_frame", inside)))
    # without a following run the stability is never examined and counts as given
    own_frame = F.when(short & (F.col("__next").isNull() | stable), F.coalesce(still, F.greatest(F.lit(1), default))).otherwise(default)
    no_number, initial = F.lit(None).cast("bigint"), slide & (F.coalesce("__shown", F.lit(0)) == 0)
    edges = around.select(
        "video_id", (F.col("__prev") + 1).alias("frame_id_0"), (F.col("f0") + 1).alias("frame_id_1"), no_number.alias("transition_no"),
        F.lit(True).alias("__run"), "seg_idx", "f0", "f1", default.alias("__frame"),
        F.when(initial, 0).when(slide & (length >= backfill_min), 1).alias("sort_priority"),
        F.when(moves, F.col("__next.seg_idx")).otherwise(F.col("seg_idx")).alias("__to"),
        F.when(moves, F.col("__next.slide")).otherwise(slide).alias("__to_slide"),
        F.when(moves, F.col("__next.frame")).otherwise(own_frame).alias("__to_frame"),
    )
    given = transitions.select("video_id", "frame_id_0", "frame_id_1", "transition_no", F.lit(False).alias("__run"))
    known = F.col("video_id").isNotNull() & F.col("frame_id_0").isNotNull() & F.col("frame_id_1").isNotNull()
    # the run that starts at a transition; the later run wins
    edge = F.when(F.col("__run") & known, F.struct("seg_idx", "__to", "__to_slide", "__to_frame"))
    met = (
        given.unionByName(edges, allowMissingColumns=True)
        .withColumn("__t", F.max(edge).over(Window.partitionBy("video_id", "frame_id_0", "frame_id_1")))
        .where(~F.col("__run") | F.col("sort_priority").isNotNull())
    )
    # a transition that leads to the same run as the one before goes; unmatched ones always stay
    target, none = F.col("__t.__to"), F.lit(-1).cast("bigint")
    scanned = (
        OrderedScan(met, ["video_id"], ["transition_no"])
        .lag("__before", F.when(~F.col("__run"), F.coalesce(target, none)))
        .whole_max("__first", F.when((F.col("sort_priority") == 0) & F.col("video_id").isNotNull(), F.col("seg_idx"))).apply(False)
        .where(F.col("__run") | target.isNull() | (target != F.coalesce("__before", "__first", none)))
    )

    def either(of_run, of_transition):
        return F.when(F.col("__run"), of_run).otherwise(of_transition)

    frame = F.when(target.isNull(), F.greatest(F.lit(1), F.col("frame_id_1") + settle)).otherwise(F.col("__t.__to_frame"))
    to_slide = F.col("__t.__to_slide")
    return scanned.select(
        "video_id", either(F.col("__frame"), frame).cast("bigint").alias("event_frame"),
        either(F.col("sort_priority"), F.lit(0)).alias("sort_priority"),
        either(F.col("f0"), F.col("frame_id_0")).alias("frame_id_0"), either(F.col("f1"), F.col("frame_id_1")).alias("frame_id_1"),
        either(F.lit(0).cast("bigint"), F.col("transition_no")).alias("transition_no"),
        either(F.lit(True), F.coalesce(to_slide, F.lit(True))).alias("updates_slide_state"),
        either(F.col("seg_idx"), F.when(to_slide, target)).alias("seg_idx"),
    )


def blend_targets(
    matched: DataFrame, runs: DataFrame, stable: DataFrame, blend_max: int = 40, split: bool | None = None
) -> DataFrame:
    """A short run of moving video without a stable part hands its transition to the next slide run.

    ``stable``: video_id, seg_idx, has_stable_part for the short video runs.
    """
    around = (
        OrderedScan(runs.select("video_id", "seg_idx", "slide_id", "f0", "f1"), ["video_id"], ["seg_idx"])
        .lead("__next", F.struct("seg_idx", "slide_id", "f0", "f1"))
        .apply(split)
        .join(stable.select("video_id", "seg_idx", "has_stable_part"), ["video_id", "seg_idx"], "left")
    )
    short = (F.col("slide_id") < 0) & (F.col("f1") - F.col("f0") + 1 <= blend_max)
    moves = (
        short & F.col("__next").isNotNull() & ~F.coalesce("has_stable_part", F.lit(False))
        & (F.col("__next.slide_id") >= 0)
    )
    own = F.struct("seg_idx", "slide_id", "f0", "f1")
    chosen = around.select(
        "video_id", F.col("seg_idx").alias("target_seg_idx"),
        F.when(moves, F.col("__next")).otherwise(own).alias("__t"),
        # without a following run the stability is never examined and counts as given
        F.when(F.col("__next").isNull(), F.lit(True)).otherwise(
            F.coalesce("has_stable_part", F.lit(False))).alias("keep_short"),
    )
    return (
        matched.join(chosen, ["video_id", "target_seg_idx"], "left")
        .withColumn("target_seg_idx", F.col("__t.seg_idx"))
        .withColumns({"slide_id": F.col("__t.slide_id"), "f0": F.col("__t.f0"), "f1": F.col("__t.f1")})
        .drop("__t")
    )


def suppress_repeats(targets: DataFrame, initial: DataFrame, split: bool | None = None) -> DataFrame:
    """Drop a transition that leads to the same run as the one before; unmatched ones always stay."""
    first = initial.select("video_id", F.col("seg_idx").alias("__first"))
    scanned = (
        OrderedScan(targets.join(first, "video_id", "left"), ["video_id"], ["transition_no"])
        .lag("__prev", F.coalesce("target_seg_idx", F.lit(-1).cast("bigint")))
        .apply(split)
    )
    before = F.coalesce("__prev", "__first", F.lit(-1).cast("bigint"))
    return scanned.where(
        F.col("target_seg_idx").isNull() | (F.col("target_seg_idx") != before)
    ).drop("__prev", "__first")


def long_slide_runs(runs: DataFrame, min_frames: int = 12) -> DataFrame:
    return runs.where((F.col("slide_id") >= 0) & (F.col("f1") - F.col("f0") + 1 >= min_frames))


def keep_uncovered(candidates: DataFrame, split: bool | None = None) -> DataFrame:
    """Late candidates (priority 1) only where no primary one has the same run.

    One grouping of the union decides it, so the primary candidates are not computed twice.
    """
    primary = F.bool_or(F.col("sort_priority") == 0)
    marked = with_group_values(candidates, ["video_id", "seg_idx"], {"__covered": primary}, split)
    return marked.where((F.col("sort_priority") == 0) | ~F.col("__covered")).drop("__covered")


def keep_uncovered_ended(candidates: DataFrame, media: DataFrame) -> DataFrame:
    """``keep_uncovered`` for ordinary videos with their number of frames as ``__frames``, by one window over both tables."""
    ends = media.select("video_id", F.col("frame_count").alias("__frames"), F.lit(True).alias("__end"))
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    marked = candidates.withColumn("__end", F.lit(False)).unionByName(ends, allowMissingColumns=True).withColumns({
        "__covered": F.bool_or(F.col("sort_priority") == 0).over(w.rangeBetween(Window.currentRow, Window.currentRow)),
        "__frames": F.max("__frames").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    return marked.where(~F.col("__end") & ((F.col("sort_priority") == 0) | ~F.col("__covered"))).drop("__covered", "__end")


def backfill_candidates(runs: DataFrame, covered: DataFrame, min_frames: int = 12) -> DataFrame:
    """Long enough slide runs that no candidate covers yet."""
    return long_slide_runs(runs, min_frames).join(covered.select("video_id", "seg_idx").distinct(), ["video_id", "seg_idx"], "left_anti")


def dedupe_backfills(
    candidates: DataFrame, patches: DataFrame, threshold: float, piece_rows: int = PIECE_ROWS, split: bool | None = None,
    picture: str | None = None,
) -> DataFrame:
    """Late candidates that look like the last kept frame, or as a slide like the last slide's frame, are dropped.

    ``patches(video_id, frame_id, patch)``, one for a frame; candidates whose
    frame has no patch are unreadable and go. Only patches that can be compared
    enter the fold. Where frames share pictures, ``picture`` is the column of
    the candidates that names theirs, and ``patches`` holds that column and
    ``patch``, one row for a picture: candidates need not be dealt out by frame.
    """
    def step(last, at, flags, patch):
        (late, slide), (kept, shown) = flags, last
        seen = [x[1] for x in (kept, shown if slide else None) if x is not None]
        if late == 1 and any(alike(patch, x, threshold) for x in seen):
            return last, 0
        return [(at, patch), (at, patch) if slide else shown], 1

    if picture is None:
        own, place = patches.select("video_id", F.col("frame_id").alias("event_frame"), "patch"), ["video_id", "event_frame"]
    else:
        own, place = patches.select(picture, "patch"), [picture]
    readable = candidates.join(own.select(*place), place, "left_semi")
    if picture is not None:
        # as a frame without a video has no patch
        readable = readable.where(F.col("video_id").isNotNull() & F.col("event_frame").isNotNull())
    # what a late candidate may be compared with: itself, the row before it, and the last slide before it
    late, slide = F.col("sort_priority") == 1, F.col("updates_slide_state")
    marked = (
        OrderedScan(readable, ["video_id"], CANDIDATE_ORDER).next_value("__late", late)
        .next_value("__ahead", F.when(late, F.lit(1)).when(slide, F.lit(0))).apply(split)
    )
    compared = late | F.coalesce(F.col("__late"), F.lit(False)) | F.coalesce(slide & (F.col("__ahead") == 1), F.lit(False))
    rows = marked.withColumn("__compared", compared).join(own.withColumn("__compared", F.lit(True)), [*place, "__compared"], "left").select(
        "video_id", *CANDIDATE_ORDER, slide.cast("int").alias("__slide"), "patch")
    judged = speculative_fold(
        rows, ["video_id"], CANDIDATE_ORDER, "patch", ["sort_priority", "__slide"], step, 2, "__stays", piece_rows, split)
    return judged.where("__stays = 1").drop("__stays")


def number_events(candidates: DataFrame, fps_milli: int = 25_000, split: bool | None = None) -> DataFrame:
    """Events in frame order with their time; time = (frame - 1) / fps."""
    ms = F.bround((F.col("event_frame") - 1) * 1_000_000 / fps_milli).cast("bigint")
    return (
        OrderedScan(candidates, ["video_id"], CANDIDATE_ORDER).row_number("event_id").apply(split)
        .select("video_id", "event_id", "transition_no", "frame_id_0", "frame_id_1", "event_frame",
                ms.alias("time_ms"), timecode(ms).alias("timecode"))
    )
