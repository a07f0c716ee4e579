"""Only pictures that can be compared travel with the candidates of a video."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import changes, speculative


def test_pictures_that_nothing_is_compared_with_stay_behind(spark, monkeypatch):
    """Of six primary candidates the one before the late one and the last slide before it count; floats stay floats."""
    shape = "video_id bigint, event_frame bigint, sort_priority int, frame_id_0 bigint, frame_id_1 bigint, transition_no bigint, updates_slide_state boolean"
    rows = [(1, f, int(f == 5), f, f, 0, f != 4) for f in range(1, 8)]
    seen = spark.createDataFrame([(1, f, [0.1 * f, 1.0]) for f in range(1, 8)], "video_id bigint, frame_id bigint, patch array<float>")
    kept = []

    def noting(df, *args, **kwargs):
        kept.append(df)
        return speculative.speculative_fold(df, *args, **kwargs)

    monkeypatch.setattr(changes, "speculative_fold", noting)
    out = changes.dedupe_backfills(spark.createDataFrame(rows, shape), seen, 0.01)
    assert sorted(r.event_frame for r in out.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert kept[0].schema["patch"].dataType.simpleString() == "array<float>"
    assert sorted(r.event_frame for r in kept[0].where("patch IS NOT NULL").collect()) == [3, 4, 5]


def test_videos_are_deduplicated_where_they_lie(spark):
    """Whole videos are folded in place: nothing is kept on disk, and no picture is shuffled."""
    plan = entry.queries()["dedupe_backfills"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and "ExistingRDD" not in plan and len(dealt) == len(
        [line for line in entry.queries()["candidate_union"](spark, SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
         if "Exchange hashpartitioning" in line])


@pytest.mark.parametrize("sent", ["10MB", "-1"])
def test_shared_pictures_give_the_same_as_those_of_frames(spark, sent):
    rnd = random.Random(4)
    shape = "video_id bigint, event_frame bigint, sort_priority int, frame_id_0 bigint, frame_id_1 bigint, transition_no bigint, updates_slide_state boolean, pic bigint"
    rows = [(v, f, rnd.choice([0, 1, 1]), f, f, 0, rnd.random() < 0.6, rnd.choice([None, 9, *range(4)])) for v in [*range(8), None] for f in range(1, 40)]
    pictures = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 1.0]), (3, [2.0])], "pic bigint, patch array<float>")
    df = spark.createDataFrame(rows, shape).repartition(5)
    frames = df.join(pictures, "pic").select("video_id", F.col("event_frame").alias("frame_id"), "patch")

    def stays(out):
        return sorted((r.video_id, r.event_frame) for r in out.collect())

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    try:
        want = stays(changes.dedupe_backfills(df, frames, 0.1, piece_rows=3))
        assert 0 < len(want) < len(rows)
        assert stays(changes.dedupe_backfills(df, frames, 0.1, split=False)) == want
        for split in (False, True):
            assert stays(changes.dedupe_backfills(df, pictures, 0.1, 3, split, "pic")) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
