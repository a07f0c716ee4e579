"""Worked cases of rules that are easy to get wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import boxes, text, times
from lectern.functions.measures import histogram_similarity, mad, nearest_percentiles
from lectern.operators import final_slides, intervals, segments, speech
from lectern.plans.slide_text_map import slide_text_map

SEG = "video_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string"
CHG = "video_id bigint, event_id bigint, time_ms bigint"


def test_touching_ranges_do_not_overlap_and_gaps_are_filled(spark):
    s = spark.createDataFrame([(1, 1, 0, 1000, "a b"), (1, 2, 1000, 2000, "c d"), (2, 1, 0, 500, "alone")], SEG)
    c = spark.createDataFrame([(1, 7, 1000)], CHG)
    got = {(r.video_id, r.bucket_id): r for r in slide_text_map(s, c).collect()}
    assert set(got) == {(1, "no_slide_001"), (1, "event_007"), (2, "no_slide_001")}
    assert got[(1, "no_slide_001")].text == "a b" and got[(1, "event_007")].text == "c d"
    assert got[(1, "no_slide_001")].merge_target_event_id is None
    assert (got[(2, "no_slide_001")].slide_start_ms, got[(2, "no_slide_001")].slide_end_ms) == (0, 500)


def test_fewer_words_than_parts_go_to_the_longest(spark):
    s = spark.createDataFrame([(1, 1, 0, 300, "one two")], SEG)
    c = spark.createDataFrame([(1, 1, 0), (1, 2, 50), (1, 3, 200)], CHG)
    got = {r.bucket_id: r.text for r in slide_text_map(s, c).collect()}
    assert got == {"event_001": "", "event_002": "one two", "event_003": ""}


def test_another_video_changes_nothing(spark):
    s = spark.createDataFrame([(1, 1, 0, 900, "a b c"), (1, 2, 900, 2000, "d e")], SEG)
    c = spark.createDataFrame([(1, 1, 100), (1, 2, 1500)], CHG)
    more_s = s.union(spark.createDataFrame([(9, 1, 0, 5000, "noise " * 30)], SEG))
    more_c = c.union(spark.createDataFrame([(9, 4, 10)], CHG))
    one = sorted(map(str, slide_text_map(s, c).collect()))
    both = sorted(map(str, slide_text_map(more_s, more_c).where("video_id = 1").collect()))
    assert one == both


MAP = ("video_id bigint, bucket_id string, event_id bigint, slide_start_ms bigint, slide_end_ms bigint, is_no_slide boolean, "
       "is_speaker_only boolean, text string, translated_text string, target_language string, source_segment_ids array<bigint>")


def _deck(spark, rows):
    data = [(1, b, e, a, a + 100, e == 0, sp, t, "", "de", [i]) for i, (b, e, a, sp, t) in enumerate(rows)]
    df = spark.createDataFrame(data, MAP)
    folded = final_slides.fold_into_previous(final_slides.mark_folds(df, False))
    slides = folded.withColumn("target_gid", F.col("gid"))
    return {r.bucket_id: r for r in final_slides.place_leading_text(final_slides.collapse_duplicates(slides), False).collect()}


def test_thumbnail_text_is_erased_unless_it_received_some(spark):
    got = _deck(spark, [("no_slide_001", 0, 0, False, "lead"), ("event_001", 1, 100, False, "thumb"), ("event_002", 2, 200, False, "two")])
    assert got["event_001"].text == "" and got["event_001"].segments_count == 0
    assert got["event_002"].text == "lead two" and got["event_002"].source_segment_ids == [0, 2]
    got = _deck(spark, [("event_001", 1, 100, False, "thumb"), ("event_002", 2, 200, True, "talk")])
    assert got["event_001"].text == "thumb talk" and got["event_001"].slide_end_ms == 300


def test_single_slide_drops_leading_text_and_no_slide_keeps_it(spark):
    got = _deck(spark, [("no_slide_001", 0, 0, False, "lead"), ("event_001", 1, 100, False, "thumb")])
    assert [r.text for r in got.values()] == [""]
    got = _deck(spark, [("no_slide_001", 0, 0, False, "lead"), ("event_001", 1, 100, True, "talk")])
    assert list(got) == ["no_slide_leading"] and got["no_slide_leading"].text == "lead talk"


def test_largest_remainder_prefers_the_later_segment_on_ties(spark):
    rows = [(1, 1, i, 100, 5) for i in (1, 2, 3)] + [(2, 1, i, 100, 2) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "video_id bigint, chunk_index bigint, segment_id bigint, weight bigint, total_words bigint")
    got = {(r.video_id, r.segment_id): r.words for r in speech.allocate_words(df).collect()}
    assert [got[(1, i)] for i in (1, 2, 3)] == [1, 2, 2]
    assert [got[(2, i)] for i in (1, 2, 3)] == [None, None, None]


def test_long_ranges_meet_once(spark):
    a = spark.createDataFrame([(1, 0, 400_000)], "k bigint, s bigint, e bigint")
    b = spark.createDataFrame([(1, 10, 300_000), (1, 399_999, 500_000), (1, 400_000, 400_001)], "k bigint, s2 bigint, e2 bigint")
    assert intervals.overlap_join(a, b, "k", ("s", "e"), ("s2", "e2"), 60_000).count() == 2


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        times.timecode(F.lit(3_723_004)).alias("tc"), times.srt_time(F.lit(360_000_000)).alias("srt"),
        text.short_text(F.lit("x" * 60)).alias("short"), text.lang_slug(F.lit(" Português (BR) ")).alias("slug"),
        text.run_label(F.lit("2024-12-03_07-08")).alias("label"), text.norm_slide(F.lit("“ﬁne”  x\r\n y")).alias("norm"),
        text.token_count(F.lit("über_x straße")).alias("n"), F.array_join(text.tokens(F.lit("Ünder_score É")), ",").alias("tok"),
        mad(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("inf"),
        histogram_similarity(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 4, 6))))[1].alias("r"),
        F.to_json(text.split_units(F.lit("One. Two!\n\nThree"))).alias("parts"),
    ).first()
    assert row.tc == "01:02:03.004" and row.srt == "100:00:00,000"
    assert row.short == "x" * 47 + "…" and row.slug == "portugu-s-br"
    assert row.label == "03-Dec-2024, 07:08" and row.norm == '"fine" x y'
    assert row.n == 2 and row.tok == "underscore,e" and row.inf == float("inf") and row.r == 1.0
    assert row.parts == '["One."," ","Two!","\\n\\n","Three"]'


def test_nearest_percentile_is_half_even(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20, 30)], "k bigint, v bigint")
    assert nearest_percentiles(df, ["k"], "v", {"p": 0.75, "q": 0.25}).first()[:] == (1, 30, 10)


def test_clamped_region(spark):
    v = [F.lit(x).cast("bigint") for x in (-5, 700, 5000, 710, 1280, 720)]
    assert spark.range(1).select(*boxes.clamp_roi(*v)).first()[:] == (0, 700, 1280, 710)


def test_segments_are_clamped_to_the_recording(spark):
    s = spark.createDataFrame([(1, 1, -50, 400, "a"), (1, 2, 900, 2000, "b"), (1, 3, 1500, 1600, "c")], SEG)
    d = spark.createDataFrame([(1, 1000)], "video_id bigint, duration_ms bigint")
    got = [tuple(r)[:4] for r in segments.clamp_segments(s, d).select("segment_id", "start_ms", "end_ms", "duration_ms").orderBy("segment_id").collect()]
    assert got == [(1, 0, 400, 400), (2, 900, 1000, 100)]
