"""Queries over segments, slide changes and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import intervals, segments, slide_text
from lectern.plans.slide_text_map import slide_text_map
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query

# Common expressions of the slide text map, in the order they build on each other.
CLEAN = r"""
clean AS (SELECT video_id, segment_id, start_ms, GREATEST(start_ms, end_ms) AS end_ms,
                 trim(regexp_replace(text, '\s+', ' ', 'g')) AS text
          FROM segments_fx WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')"""
DUR = """
dur AS (SELECT video_id, GREATEST(MAX(t), 0) AS duration_ms
        FROM (SELECT video_id, end_ms AS t FROM clean UNION ALL SELECT video_id, time_ms FROM slide_changes_fx) u
        GROUP BY 1)"""
IV = """
iv AS (SELECT video_id, event_id, time_ms, start_ms, duration_ms,
              LEAST(GREATEST(start_ms, COALESCE(nxt, duration_ms)), duration_ms) AS end_ms
       FROM (SELECT c.video_id, event_id, time_ms, duration_ms, LEAST(GREATEST(time_ms, 0), duration_ms) AS start_ms,
                    LEAD(time_ms) OVER (PARTITION BY c.video_id ORDER BY time_ms, event_id) AS nxt
             FROM slide_changes_fx c JOIN dur d ON c.video_id = d.video_id) t)"""
BUCKETS = """
cur AS (SELECT *, GREATEST(start_ms, c0) AS from_ms, end_ms > GREATEST(start_ms, c0) AS kept, start_ms > c0 AS gap
        FROM (SELECT *, COALESCE(MAX(end_ms) OVER (PARTITION BY video_id ORDER BY time_ms, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0 FROM iv) t),
pieces AS (SELECT video_id, event_id, from_ms AS s, end_ms AS e, FALSE AS is_no_slide FROM cur WHERE kept
           UNION ALL SELECT video_id, 0, c0, start_ms, TRUE FROM cur WHERE gap
           UNION ALL SELECT d.video_id, 0, COALESCE(m, 0), duration_ms, TRUE
                     FROM dur d LEFT JOIN (SELECT video_id, MAX(end_ms) AS m FROM iv GROUP BY 1) q ON d.video_id = q.video_id
                     WHERE duration_ms > COALESCE(m, 0)),
buckets AS (SELECT video_id, s AS slide_start_ms, e AS slide_end_ms, is_no_slide, event_id,
                   CASE WHEN is_no_slide
                        THEN LAST_VALUE(CASE WHEN NOT is_no_slide THEN event_id END IGNORE NULLS) OVER w
                        ELSE event_id END AS merge_target_event_id,
                   CASE WHEN is_no_slide
                        THEN printf('no_slide_%03d', CAST(SUM(CASE WHEN is_no_slide THEN 1 ELSE 0 END) OVER w AS BIGINT))
                        ELSE printf('event_%03d', event_id) END AS bucket_id
            FROM pieces
            WINDOW w AS (PARTITION BY video_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
USABLE = """
usable AS (SELECT * FROM (SELECT c.video_id, segment_id, text, LEAST(GREATEST(start_ms, 0), duration_ms) AS start_ms,
                                 LEAST(GREATEST(GREATEST(start_ms, 0), end_ms), duration_ms) AS end_ms
                          FROM clean c JOIN dur d ON c.video_id = d.video_id) t WHERE end_ms > start_ms)"""
LATEST = """
latest AS (SELECT video_id, CAST(segment_id AS BIGINT) AS segment_id,
                  trim(arg_max(translated_text, pos)) AS translated_text,
                  trim(arg_max(target_language, pos)) AS target_language
           FROM translations_fx WHERE try_cast(segment_id AS BIGINT) IS NOT NULL GROUP BY 1, 2)"""
OVERLAPS = r"""
ov AS (SELECT s.video_id, s.segment_id, s.start_ms, s.end_ms, s.text, b.bucket_id, b.slide_start_ms AS bucket_start_ms,
              LEAST(s.end_ms, b.slide_end_ms) - GREATEST(s.start_ms, b.slide_start_ms) AS overlap_ms,
              trim(regexp_replace(COALESCE(l.translated_text, ''), '\s+', ' ', 'g')) AS translated_text,
              COALESCE(l.target_language, '') AS target_language
       FROM usable s JOIN buckets b ON s.video_id = b.video_id AND s.start_ms < b.slide_end_ms AND b.slide_start_ms < s.end_ms
       LEFT JOIN latest l ON s.video_id = l.video_id AND s.segment_id = l.segment_id)"""
SHARES = """
measured AS (SELECT *, SUM(overlap_ms) OVER w AS cum, SUM(overlap_ms) OVER g AS total, COUNT(*) OVER g AS parts,
                    ROW_NUMBER() OVER w AS rn,
                    ROW_NUMBER() OVER (PARTITION BY video_id, segment_id ORDER BY overlap_ms DESC, bucket_start_ms) AS longest
             FROM ov
             WINDOW w AS (PARTITION BY video_id, segment_id ORDER BY bucket_start_ms),
                    g AS (PARTITION BY video_id, segment_id)),
worded AS (SELECT *, string_split(text, ' ') AS w1, string_split(translated_text, ' ') AS w2 FROM measured),
shares AS (SELECT *,
  CASE WHEN text = '' THEN '' WHEN parts = 1 THEN text
       WHEN len(w1) < parts THEN CASE WHEN longest = 1 THEN text ELSE '' END
       ELSE array_to_string(w1[CAST(round_even((cum - overlap_ms) / total * len(w1), 0) AS BIGINT) + 1 :
            CASE WHEN rn = parts THEN len(w1) ELSE CAST(round_even(cum / total * len(w1), 0) AS BIGINT) END], ' ') END AS chunk,
  CASE WHEN translated_text = '' THEN '' WHEN parts = 1 THEN translated_text
       WHEN len(w2) < parts THEN CASE WHEN longest = 1 THEN translated_text ELSE '' END
       ELSE array_to_string(w2[CAST(round_even((cum - overlap_ms) / total * len(w2), 0) AS BIGINT) + 1 :
            CASE WHEN rn = parts THEN len(w2) ELSE CAST(round_even(cum / total * len(w2), 0) AS BIGINT) END], ' ') END AS t_chunk
  FROM worded)"""
TEXT_MAP = """
text_map AS (SELECT b.video_id, b.bucket_id, b.event_id, b.slide_start_ms, b.slide_end_ms, b.is_no_slide, b.merge_target_event_id,
       COALESCE(string_agg(s.chunk, ' ' ORDER BY s.start_ms, s.end_ms, s.segment_id) FILTER (WHERE s.chunk <> ''), '') AS text,
       COALESCE(string_agg(s.t_chunk, ' ' ORDER BY s.start_ms, s.end_ms, s.segment_id) FILTER (WHERE s.t_chunk <> ''), '') AS translated_text,
       COALESCE(arg_min(s.target_language, s.segment_id) FILTER (WHERE s.target_language <> ''), '') AS target_language,
       COUNT(DISTINCT s.segment_id) AS segments_count,
       COALESCE(string_agg(DISTINCT CAST(s.segment_id AS VARCHAR), ';' ORDER BY CAST(s.segment_id AS VARCHAR)), '') AS id_text,
       list_sort(COALESCE(list(DISTINCT s.segment_id) FILTER (WHERE s.segment_id IS NOT NULL), [])) AS ids,
       COUNT(s.segment_id) AS mapped_fragments
FROM buckets b LEFT JOIN shares s ON b.video_id = s.video_id AND b.bucket_id = s.bucket_id
GROUP BY ALL)"""

FLAGSHIP = ",".join([CLEAN, DUR, IV, BUCKETS, USABLE, LATEST, OVERLAPS, SHARES, TEXT_MAP])
BASE = ("segments_fx", "slide_changes_fx")


@query("slide_text_map", with_fixtures(FLAGSHIP + """
SELECT video_id, bucket_id, event_id, slide_start_ms, slide_end_ms, is_no_slide, merge_target_event_id, text,
       translated_text, target_language, segments_count, array_to_string(ids, ';') AS source_segment_ids, mapped_fragments
FROM text_map""", *BASE, "translations_fx"))
def q_slide_text_map(t):
    out = slide_text_map(t.segments(), t.slide_changes(), t.translations(), split=t.by_video)
    return out.withColumn("source_segment_ids", F.array_join("source_segment_ids", ";"))


@query("clean_segments", with_fixtures(CLEAN + " SELECT * FROM clean", "segments_fx"))
def q_clean(t):
    return segments.clean_segments(t.segments())


@query("media_duration", with_fixtures(CLEAN + "," + DUR + " SELECT * FROM dur", *BASE))
def q_duration(t):
    return segments.media_duration(segments.clean_segments(t.segments()), t.slide_changes())


@query("transcript_span", with_fixtures(
    "SELECT video_id, MAX(end_ms) - MIN(start_ms) AS span_ms FROM segments_fx GROUP BY 1", "segments_fx"))
def q_span(t):
    return segments.transcript_span(t.segments())


@query("clamp_segments", with_fixtures("""
SELECT *, end_ms - start_ms AS duration_ms
FROM (SELECT s.video_id, segment_id, LEAST(start_ms, d) AS start_ms, LEAST(end_ms, d) AS end_ms, text
      FROM segments_fx s JOIN (SELECT video_id, MAX(end_ms) * 3 // 4 AS d FROM segments_fx GROUP BY 1) q
        ON s.video_id = q.video_id) t
WHERE end_ms > start_ms""", "segments_fx"))
def q_clamp(t):
    s = t.segments()
    d = s.groupBy("video_id").agg(F.floor(F.max("end_ms") * 3 / 4).alias("duration_ms"))
    return segments.clamp_segments(s, d)


@query("slide_intervals", with_fixtures(CLEAN + "," + DUR + "," + IV + """
SELECT * FROM iv UNION ALL
SELECT d.video_id, NULL, NULL, 0, duration_ms, 0 FROM dur d
WHERE NOT EXISTS (SELECT 1 FROM slide_changes_fx c WHERE c.video_id = d.video_id)""", *BASE))
def q_intervals(t):
    d = segments.media_duration(segments.clean_segments(t.segments()), t.slide_changes())
    return intervals.slide_intervals(t.slide_changes(), d, t.by_user)


def _buckets(t):
    d = segments.media_duration(segments.clean_segments(t.segments()), t.slide_changes())
    return intervals.fill_buckets(intervals.slide_intervals(t.slide_changes(), d, t.by_user), t.by_user)


@query("fill_buckets", with_fixtures(",".join([CLEAN, DUR, IV, BUCKETS]) + " SELECT * FROM buckets", *BASE))
def q_buckets(t):
    return _buckets(t)


@query("merge_target", with_fixtures(",".join([CLEAN, DUR, IV, BUCKETS]) + """
SELECT video_id, bucket_id, merge_target_event_id FROM buckets WHERE is_no_slide""", *BASE))
def q_merge_target(t):
    return _buckets(t).where("is_no_slide").select("video_id", "bucket_id", "merge_target_event_id")


def _overlaps(t):
    latest = slide_text.latest_translations(t.translations())
    s = slide_text.attach_translations(segments.clean_segments(t.segments()), latest)
    return intervals.map_overlaps(s, _buckets(t))


@query("map_overlaps", with_fixtures(",".join([CLEAN, DUR, IV, BUCKETS, USABLE, LATEST, OVERLAPS]) + """
SELECT video_id, segment_id, bucket_id, bucket_start_ms, overlap_ms FROM ov""", *BASE, "translations_fx"))
def q_overlaps(t):
    return _overlaps(t).select("video_id", "segment_id", "bucket_id", "bucket_start_ms", "overlap_ms")


@query("apportion_words", with_fixtures(",".join([CLEAN, DUR, IV, BUCKETS, USABLE, LATEST, OVERLAPS, SHARES]) + """
SELECT video_id, segment_id, bucket_id, overlap_ms, chunk FROM shares""", *BASE, "translations_fx"))
def q_apportion(t):
    out = segments.apportion_words(_overlaps(t), "text", "chunk", t.by_video)
    return out.select("video_id", "segment_id", "bucket_id", "overlap_ms", "chunk")


@query("latest_translations", with_fixtures(LATEST + " SELECT * FROM latest", "translations_fx"))
def q_latest(t):
    return slide_text.latest_translations(t.translations())


@query("attach_translations", with_fixtures(LATEST + """
SELECT s.video_id, s.segment_id, s.text, COALESCE(l.translated_text, '') AS translated_text,
       COALESCE(l.target_language, '') AS target_language
FROM segments_fx s LEFT JOIN latest l ON s.video_id = l.video_id AND s.segment_id = l.segment_id""",
    "segments_fx", "translations_fx"))
def q_attach(t):
    latest = slide_text.latest_translations(t.translations())
    out = slide_text.attach_translations(t.segments(), latest)
    return out.select("video_id", "segment_id", "text", "translated_text", "target_language")


@query("assemble_text", with_fixtures(FLAGSHIP + """
SELECT video_id, bucket_id, text, segments_count, mapped_fragments FROM text_map""", *BASE, "translations_fx"))
def q_assemble(t):
    out = slide_text.assemble_text(_buckets(t), _overlaps(t), t.by_video)
    return out.select("video_id", "bucket_id", "text", "segments_count", "mapped_fragments")


FRAMED = """
framed AS (SELECT video_id, event_id, GREATEST(1, s * 25 // 1000 + 1) AS fa,
                  GREATEST(GREATEST(1, s * 25 // 1000 + 1), CAST(ceil(GREATEST(s, e) * 25 / 1000.0) AS BIGINT)) AS fb
           FROM (SELECT video_id, event_id, time_ms AS s,
                        COALESCE(LEAD(time_ms) OVER (PARTITION BY video_id ORDER BY time_ms, event_id), 40000) AS e
                 FROM slide_changes_fx) t)"""


def timed_events(t):
    """Slide changes with the time of the next one as their end."""
    from lectern.operators.scan import OrderedScan

    return (
        OrderedScan(t.slide_changes(), ["video_id"], ["time_ms", "event_id"]).lead("e", "time_ms").apply(t.by_user)
        .select("video_id", F.col("event_id").alias("bucket_id"), "event_id", F.col("time_ms").alias("slide_start_ms"),
                F.coalesce("e", F.lit(40000)).cast("bigint").alias("slide_end_ms"))
    )


@query("stage1_video_ratio", with_fixtures(FRAMED + """
SELECT f.video_id, f.event_id, f.fb - f.fa + 1 AS total_frames,
       CASE WHEN EXISTS (SELECT 1 FROM frame_runs_fx r WHERE r.video_id = f.video_id) THEN
         (SELECT CAST(COALESCE(SUM(LEAST(f.fb, r.f1) - GREATEST(f.fa, r.f0) + 1), 0) AS BIGINT) FROM frame_runs_fx r
          WHERE r.video_id = f.video_id AND r.slide_id < 0 AND r.f0 <= f.fb AND r.f1 >= f.fa) END AS video_frames
FROM framed f""", "slide_changes_fx", "frame_runs_fx"))
def q_ratio(t):
    out = intervals.stage1_video_ratio(timed_events(t), t.frame_runs())
    return out.select("video_id", F.col("bucket_id").alias("event_id"), "total_frames", "video_frames")


@query("audio_ranges", """
WITH r AS (SELECT user_id AS video_id, COUNT(*) * 30000 + user_id AS total_frames, 16000 AS rate FROM events GROUP BY 1)
SELECT video_id, k + 1 AS range_no, k * 868000 AS start_frame, LEAST(total_frames, k * 868000 + 880000) AS end_frame
FROM (SELECT video_id, total_frames,
             unnest(range(0, GREATEST(1, CAST(ceil((total_frames - 880000) / 868000.0) AS BIGINT) + 1))) AS k FROM r) t""")
def q_ranges(t):
    r = t.base("events").groupBy(F.col("user_id").alias("video_id")).agg(
        (F.count(F.lit(1)) * 30000 + F.col("user_id")).alias("total_frames"))
    return segments.audio_ranges(r.withColumn("sample_rate", F.lit(16000)))


@query("stitch_overlaps")
def q_stitch(t):
    """Order-bound fold; checked against a plain loop in the tests."""
    c = t.base("conversations")
    return segments.stitch_overlaps(c.select(
        F.col("conv_id").alias("video_id"), F.floor(F.col("turn") / 3).alias("chunk_no"),
        (F.col("turn") % 3).alias("result_no"), (F.floor(F.col("turn") / 3) * 2200).alias("chunk_start_ms"),
        F.lit(3000).cast("bigint").alias("chunk_ms"), F.lit(0).cast("bigint").alias("duration_ms"),
        F.when(F.col("turn") % 4 == 2, 0).otherwise((F.col("turn") % 3 + 1) * 900 + F.length("text") % 300)
        .cast("bigint").alias("end_offset_ms"), "text"), t.by_conversation)
