"""Slide change candidates by windows: the rows of the joined steps, from whole videos that are dealt out once."""

from __future__ import annotations

import re

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern import settings
from lectern.operators import changes
from lectern.plans import slide_changes as job

RUNS = "video_id bigint, seg_idx bigint, slide_id bigint, f0 bigint, f1 bigint"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _tables(spark):
    runs, moves, diffs = [], [], []
    for v in (1, 2, 3, 4, None):
        at = 1
        for i in range(9):
            kind = (i * 5 + (v or 7) * 3) % 7
            length = (3, 12, 40, 41, 8, 1, 30)[(i + (v or 5)) % 7]
            runs.append((v, i, -1 if kind in (1, 2, 4, 6) else i + 1, at, at + length - 1))
            if i and (i + (v or 0)) % 4:
                # one of them starts no run
                moves.append((v, len(moves), at, at + 1 + (i == 5)))
            at += length
        diffs += [(v, f, (f * f * 37 + (v or 0)) % (90 if f % 50 < 20 else 300)) for f in range(2, at) if v != 3]
    # a transition twice, so that the second leads to the same run
    moves += [(1, 900, moves[0][2], moves[0][3]), (1, 901, moves[0][2], moves[0][3]), (9, 1, 4, 5)]
    return (spark.createDataFrame(runs, RUNS), spark.createDataFrame(moves, "video_id bigint, transition_no bigint, frame_id_0 bigint, frame_id_1 bigint"),
            spark.createDataFrame(diffs, "video_id bigint, frame_id bigint, diff_milli bigint"))


def test_windows_give_the_candidates_of_the_joins(spark):
    runs, moves, diffs = _tables(spark)
    media = runs.groupBy("video_id").agg((F.max("f1") - 15).alias("frame_count"))
    for ends in (None, media):
        plain = job.candidates(runs, moves, diffs, split=False, media=ends, parts=3)
        joined = job.candidates(runs, moves, diffs, split=True, media=ends)
        assert plain.columns == joined.columns and dict(plain.dtypes) == dict(joined.dtypes)
        assert _rows(plain) == _rows(joined) and plain.count() > 25


def test_motion_of_short_runs_is_that_of_its_steps(spark):
    runs, _moves, diffs = _tables(spark)
    short = runs.where((F.col("slide_id") < 0) & (F.col("f1") - F.col("f0") + 1 <= 40) & F.col("video_id").isNotNull())
    motion = {(r.video_id, r.seg_idx): r for r in changes.short_run_motion(short, diffs).collect()}
    stable = changes.longest_stable_run(short, diffs, "seg_idx", split=False).collect()
    still = changes.pick_stable_frame(short.withColumn("d", F.lit(-7).cast("bigint")), diffs, "seg_idx", "d").collect()
    assert {r.longest_run for r in stable} > {1}
    for r in stable:
        assert r.longest_run == getattr(motion.get((r.video_id, r.seg_idx)), "longest_run", 1)
    picked = {(r.video_id, r.seg_idx): r.stable_frame for r in still if r.stable_frame != r.f0}
    assert picked and all(motion[k].still_frame == f for k, f in picked.items())


def test_late_candidates_are_the_uncovered_runs(spark):
    runs, moves, diffs = _tables(spark)
    out = job.candidates(runs, moves, diffs, split=False)
    covered = out.where("sort_priority = 0 AND seg_idx IS NOT NULL")
    late = out.where("sort_priority = 1").select("video_id", "seg_idx", F.col("frame_id_0").alias("f0"), F.col("frame_id_1").alias("f1"))
    known = late.where("video_id IS NOT NULL")
    want = changes.backfill_candidates(runs.where("video_id IS NOT NULL"), covered).select("video_id", "seg_idx", "f0", "f1")
    assert _rows(known) == _rows(want) and known.count() > 0


def test_videos_are_dealt_out_once(spark):
    """Runs meet transitions and each other in windows: only the interval join of short runs is one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("candidate_union", "backfill_min", "slide_changes"):
            plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"\bSortMergeJoin\b", plan)) == 1, name
            assert len(re.findall(r"\bSort \[", plan)) <= 14 and len(re.findall(r"\bExchange\b", plan)) <= 9, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_more_rows_make_more_parts(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert settings.parts_of(spark, 10) == n
    assert settings.parts_of(spark, 300 * settings.PART_ROWS + 1) == 301


def test_a_hot_key_is_found_behind_its_bucket(spark):
    df = spark.range(40).select(F.when(F.col("id") < 8, 1).otherwise(F.col("id")).alias("k"))
    spark.conf.set("lectern.maxGroupRows", "8")
    try:
        assert not settings.has_hot_key(df, ["k"])
        spark.conf.set("lectern.maxGroupRows", "7")
        assert settings.has_hot_key(df, ["k"])
    finally:
        spark.conf.unset("lectern.maxGroupRows")


def test_sums_before_a_row_are_the_same_in_pieces(spark):
    from lectern.operators.scan import OrderedScan

    df = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.when(F.col("id") > 5, F.col("id")).alias("v"))
    got = [_rows(OrderedScan(df, ["k"], ["at"]).sum_before("s", "v").apply(split)) for split in (False, True)]
    assert got[0] == got[1] and got[0][0][3] is None
