"""Queries over speech chunks, alignment, timeline, subtitles and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.times import idiv
from lectern.operators import consistency, speech, timeline
from lectern.operators.scan import OrderedScan
from lectern.plans.slide_text_map import slide_text_map
from lectern.settings import staged
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query
from lectern.suite.timed_text import BASE, FLAGSHIP

# -- speech -------------------------------------------------------------------

WEIGHTED = r"""
wt AS (SELECT video_id, (segment_id - 1) // 3 + 1 AS chunk_index, segment_id, start_ms, end_ms, text,
              GREATEST(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) * 100 + CASE WHEN right(trim(text), 1) IN ('.', '!', '?') THEN 60 WHEN right(trim(text), 1) IN (',', ';', ':') THEN 25 ELSE 0 END AS weight
       FROM segments_fx),
ck AS (SELECT video_id, chunk_index, MIN(start_ms) AS chunk_start_ms, MAX(end_ms) AS chunk_end_ms, SUM(weight) AS w, COUNT(*) AS n, (video_id * 7 + chunk_index * 5) % 23 AS total_words FROM wt GROUP BY 1, 2),
al0 AS (SELECT t.*, chunk_start_ms, chunk_end_ms, total_words, n, w, GREATEST(0, total_words - n) AS rest, weight * GREATEST(0, total_words - n) // w AS add, weight * GREATEST(0, total_words - n) % w AS frac
        FROM wt t JOIN ck ON ck.video_id = t.video_id AND ck.chunk_index = t.chunk_index),
al AS (SELECT *, CASE WHEN total_words <= 0 THEN 0 WHEN total_words < n THEN NULL
                      ELSE 1 + add + CASE WHEN ROW_NUMBER() OVER (PARTITION BY video_id, chunk_index ORDER BY frac DESC, segment_id DESC) <= rest - SUM(add) OVER (PARTITION BY video_id, chunk_index) THEN 1 ELSE 0 END END AS words FROM al0)"""


def _weighted(t):
    s = t.segments().withColumns({
        "chunk_index": idiv(F.col("segment_id") - 1, 3) + 1, "weight": speech.speech_weight(F.col("text"))})
    ck = s.groupBy(*speech.CHUNK).agg(F.min("start_ms").alias("chunk_start_ms"), F.max("end_ms").alias("chunk_end_ms"))
    ck = ck.withColumn("total_words", (F.col("video_id") * 7 + F.col("chunk_index") * 5) % 23)
    return s.join(ck, speech.CHUNK)


@query("allocate_words", with_fixtures(WEIGHTED + " SELECT video_id, segment_id, words FROM al", "segments_fx"))
def q_allocate(t):
    return speech.allocate_words(_weighted(t), split=t.by_conversation).select("video_id", "segment_id", "words")


def _recognized(t):
    """Recognized words of each chunk at even distances."""
    ck = _weighted(t).select(*speech.CHUNK, "total_words").distinct().where("total_words > 0")
    w = ck.withColumn("word_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "total_words")))
    return w.select(*speech.CHUNK, "word_no", (F.col("word_no") * 130).alias("start_ms"), (F.col("word_no") * 130 + 100).alias("end_ms"))


@query("align_by_words", with_fixtures(WEIGHTED + """,
up AS (SELECT *, SUM(words) OVER (PARTITION BY video_id, chunk_index ORDER BY segment_id) AS upto FROM al WHERE words IS NOT NULL)
SELECT video_id, segment_id, chunk_start_ms + CASE WHEN words > 0 THEN (upto - words + 1) * 130 ELSE 0 END AS tts_start_ms,
       chunk_start_ms + CASE WHEN words > 0 THEN upto * 130 + 100 ELSE 0 END AS tts_end_ms FROM up""", "segments_fx"))
def q_by_words(t):
    rows = speech.allocate_words(_weighted(t), split=t.by_conversation).where("words IS NOT NULL")
    return speech.align_by_words(rows, _recognized(t), t.by_conversation).select(
        "video_id", "segment_id", "tts_start_ms", "tts_end_ms")


PROP = """
pr AS (SELECT *, SUM(weight) OVER (PARTITION BY video_id, chunk_index ORDER BY segment_id) AS cum FROM al)"""


@query("align_proportionally", with_fixtures(WEIGHTED + "," + PROP + """
SELECT video_id, segment_id, chunk_start_ms + CAST(round_even((chunk_end_ms - chunk_start_ms) * (cum - weight) / w, 0) AS BIGINT) AS tts_start_ms,
       chunk_start_ms + CAST(round_even((chunk_end_ms - chunk_start_ms) * cum / w, 0) AS BIGINT) AS tts_end_ms FROM pr""", "segments_fx"))
def q_proportional(t):
    return speech.align_proportionally(_weighted(t), t.by_conversation).select(
        "video_id", "segment_id", "tts_start_ms", "tts_end_ms")


CHOSEN = """
up AS (SELECT a.*, a.chunk_index % 3 <> 2 AND total_words > 0 AND words IS NOT NULL AS by_words, SUM(words) OVER c AS upto, SUM(weight) OVER c AS cum
       FROM al a WINDOW c AS (PARTITION BY video_id, chunk_index ORDER BY segment_id))"""


@query("choose_alignment", with_fixtures(WEIGHTED + "," + CHOSEN + """
SELECT video_id, chunk_index, segment_id,
       chunk_start_ms + CASE WHEN by_words THEN (upto - words + 1) * 130 ELSE CAST(round_even((chunk_end_ms - chunk_start_ms) * (cum - weight) / w, 0) AS BIGINT) END AS tts_start_ms,
       chunk_start_ms + CASE WHEN by_words THEN upto * 130 + 100 ELSE CAST(round_even((chunk_end_ms - chunk_start_ms) * cum / w, 0) AS BIGINT) END AS tts_end_ms,
       CASE WHEN by_words THEN 'asr_word_count' ELSE 'proportional' END AS alignment_mode,
       CASE WHEN by_words THEN 1.0 WHEN chunk_index % 3 <> 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence
FROM up""", "segments_fx"))
def q_choose(t):
    """Word or proportional timing; of three chunks one is heard as it is, one with other signs, one not at all."""
    rows = _weighted(t).drop("weight", "total_words")
    text = rows.groupBy(*speech.CHUNK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "segment_id", "text"))), lambda p: p["text"]), " ").alias("chunk_text"))
    kind = F.col("chunk_index") % 3
    heard = F.when(kind == 0, F.col("chunk_text")).when(kind == 1, F.concat(F.lit("... "), "chunk_text", F.lit(" !"))).otherwise("")
    rows = rows.join(text.withColumn("asr_text", heard), speech.CHUNK).withColumn("tts_text", F.col("text"))
    return speech.choose_alignment(rows, _recognized(t), split=t.by_conversation)


@query("chunk_timeline", """
SELECT run AS video_id, chunk_index, CASE WHEN ok THEN upto - d ELSE 0 END AS start_ms, CASE WHEN ok THEN upto ELSE 0 END AS end_ms
FROM (SELECT *, CAST(SUM(CASE WHEN ok THEN d ELSE 0 END) OVER (PARTITION BY run ORDER BY chunk_index) AS BIGINT) AS upto
      FROM (SELECT user_id AS run, event_id AS chunk_index, event_type <> 'error' AS ok, CAST(round_even(value * 100, 0) AS BIGINT) AS d FROM events) a) b""")
def q_chunks(t):
    rows = t.base("events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("chunk_index"),
        F.when(F.col("event_type") != "error", "generated").otherwise("error").alias("status"),
        F.bround(F.col("value") * 100).cast("bigint").alias("duration_ms"))
    return speech.chunk_timeline(rows, t.by_user).select("video_id", "chunk_index", "start_ms", "end_ms")


# -- timeline -----------------------------------------------------------------

SLIDES = """
slides AS (SELECT video_id, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY slide_start_ms) AS slide_index, event_id, bucket_id, slide_start_ms, slide_end_ms,
                  CASE WHEN event_id % 4 = 1 THEN '' ELSE text END AS text, CASE WHEN event_id % 4 = 1 THEN '' ELSE translated_text END AS translated_text, ids FROM text_map WHERE NOT is_no_slide),
pairs AS (SELECT s.video_id, s.slide_index, s.slide_start_ms, s.slide_end_ms, a.* EXCLUDE (video_id) FROM (SELECT *, unnest(ids) AS sid FROM slides) s
          JOIN alignment_fx a ON a.video_id = s.video_id AND a.segment_id = s.sid)"""
WINDOWS = """
win AS (SELECT video_id, slide_index, MIN(tts_start_ms + CAST(round_even((GREATEST(slide_start_ms, source_start_ms) - source_start_ms) * (tts_end_ms - tts_start_ms) / (source_end_ms - source_start_ms), 0) AS BIGINT)) AS window_start_ms,
               MAX(tts_start_ms + CAST(round_even((LEAST(slide_end_ms, source_end_ms) - source_start_ms) * (tts_end_ms - tts_start_ms) / (source_end_ms - source_start_ms), 0) AS BIGINT)) AS window_end_ms
        FROM pairs WHERE LEAST(slide_end_ms, source_end_ms) > GREATEST(slide_start_ms, source_start_ms) GROUP BY 1, 2)"""
SLIDE_FX = (*BASE, "translations_fx", "alignment_fx")


def _slides(t):
    m = slide_text_map(t.segments(), t.slide_changes(), t.translations(), split=t.by_video).where("NOT is_no_slide")
    quiet = F.col("event_id") % 4 == 1
    rows = OrderedScan(m, ["video_id"], ["slide_start_ms"]).row_number("slide_index").apply(t.by_video)
    return staged(rows.withColumns({c: F.when(quiet, "").otherwise(F.col(c)) for c in ("text", "translated_text")}))


@query("segments_of_slide", with_fixtures(FLAGSHIP + "," + SLIDES + """
SELECT video_id, slide_index, segment_id, source_start_ms, source_end_ms, tts_start_ms, tts_end_ms FROM pairs""", *SLIDE_FX))
def q_pairs(t):
    out = timeline.segments_of_slide(_slides(t), t.alignment())
    return out.select("video_id", "slide_index", "segment_id", "source_start_ms", "source_end_ms", "tts_start_ms", "tts_end_ms")


@query("slide_audio_window", with_fixtures(FLAGSHIP + "," + SLIDES + "," + WINDOWS + " SELECT * FROM win", *SLIDE_FX))
def q_windows(t):
    return timeline.slide_audio_window(_slides(t), t.alignment())


@query("word_boundaries", with_fixtures("""
SELECT DISTINCT video_id, boundary_ms FROM (SELECT video_id, start_ms AS boundary_ms FROM words_fx UNION ALL SELECT video_id, end_ms FROM words_fx) q""", "words_fx"))
def q_boundaries(t):
    return timeline.word_boundaries(t.words())


def _totals(t):
    return t.alignment().groupBy("video_id").agg(F.max("tts_end_ms").alias("total_ms"))


SNAP = """
bd AS (SELECT video_id, start_ms AS b FROM words_fx UNION SELECT video_id, end_ms FROM words_fx),
tot AS (SELECT video_id, MAX(tts_end_ms) AS total_ms FROM alignment_fx GROUP BY 1)"""


@query("snap_nearest", with_fixtures(SNAP + """,
tm AS (SELECT c.video_id, c.event_id AS time_id, c.time_ms, total_ms FROM slide_changes_fx c JOIN tot ON tot.video_id = c.video_id),
nb AS (SELECT t.video_id, t.time_id, t.time_ms, t.total_ms, MIN(b) FILTER (WHERE b >= time_ms) AS r, MAX(b) FILTER (WHERE b < time_ms) AS l
       FROM tm t LEFT JOIN bd ON bd.video_id = t.video_id GROUP BY ALL),
bs AS (SELECT *, CASE WHEN r IS NULL THEN l WHEN l IS NULL OR r - time_ms <= time_ms - l THEN r ELSE l END AS best FROM nb)
SELECT video_id, time_id, GREATEST(0, LEAST(total_ms, CASE WHEN abs(best - time_ms) <= 350 THEN best ELSE time_ms END)) AS snapped_ms FROM bs""", "slide_changes_fx", "words_fx", "alignment_fx"))
def q_snap(t):
    times = t.slide_changes().withColumnRenamed("event_id", "time_id").join(_totals(t), "video_id")
    out = timeline.snap_nearest(times, timeline.word_boundaries(t.words()), "total_ms", split=t.by_video)
    return out.select("video_id", "time_id", "snapped_ms")


PROJECT = """
ins AS (SELECT t.video_id, t.time_id, arg_min(tts_start_ms + CAST(round_even((t.source_ms - source_start_ms) * (tts_end_ms - tts_start_ms) / (source_end_ms - source_start_ms), 0) AS BIGINT), (source_start_ms, source_end_ms, tts_start_ms)) AS v
        FROM tm t JOIN alignment_fx a ON a.video_id = t.video_id AND source_start_ms < t.source_ms AND t.source_ms < source_end_ms GROUP BY 1, 2),
edg AS (SELECT t.video_id, t.time_id, MAX(tts_end_ms) FILTER (WHERE source_end_ms = t.source_ms) AS le, MIN(tts_start_ms) FILTER (WHERE source_start_ms = t.source_ms) AS rs,
               arg_max(source_end_ms, (source_end_ms, source_start_ms, tts_start_ms)) FILTER (WHERE source_end_ms < t.source_ms) AS ls,
               arg_max(tts_end_ms, (source_end_ms, source_start_ms, tts_start_ms)) FILTER (WHERE source_end_ms < t.source_ms) AS lt,
               arg_min(source_start_ms, (source_start_ms, source_end_ms, tts_start_ms)) FILTER (WHERE source_start_ms > t.source_ms) AS rsrc,
               arg_min(tts_start_ms, (source_start_ms, source_end_ms, tts_start_ms)) FILTER (WHERE source_start_ms > t.source_ms) AS rt
        FROM tm t JOIN alignment_fx a ON a.video_id = t.video_id GROUP BY 1, 2),
raw AS (SELECT t.*, CASE WHEN e.video_id IS NULL THEN NULL WHEN v IS NOT NULL THEN v WHEN le IS NOT NULL AND rs IS NOT NULL THEN CAST(round_even((le + rs) / 2.0, 0) AS BIGINT)
                     WHEN le IS NOT NULL THEN le WHEN rs IS NOT NULL THEN rs WHEN ls IS NULL THEN 0 WHEN rsrc IS NULL THEN total_ms
                     ELSE lt + CAST(round_even((t.source_ms - ls) * (rt - lt) / (rsrc - ls), 0) AS BIGINT) END AS p,
               v IS NOT NULL OR le IS NOT NULL OR rs IS NOT NULL OR (ls IS NOT NULL AND rsrc IS NOT NULL) AS snap
        FROM tm t LEFT JOIN ins i ON i.video_id = t.video_id AND i.time_id = t.time_id LEFT JOIN edg e ON e.video_id = t.video_id AND e.time_id = t.time_id),
clamped AS (SELECT video_id, time_id, total_ms, snap, CASE WHEN p IS NOT NULL THEN GREATEST(0, LEAST(total_ms, p)) END AS p FROM raw),
near AS (SELECT c.*, MIN(b) FILTER (WHERE b >= p) AS r, MAX(b) FILTER (WHERE b < p) AS l FROM clamped c LEFT JOIN bd ON bd.video_id = c.video_id GROUP BY ALL),
proj AS (SELECT video_id, time_id, CASE WHEN snap AND abs(best - p) <= 350 THEN GREATEST(0, LEAST(total_ms, best)) ELSE p END AS projected_ms
         FROM (SELECT *, CASE WHEN r IS NULL THEN l WHEN l IS NULL OR r - p <= p - l THEN r ELSE l END AS best FROM near) q)"""


@query("project_time", with_fixtures(SNAP + """,
tm AS (SELECT c.video_id, c.event_id AS time_id, c.time_ms AS source_ms, total_ms FROM slide_changes_fx c JOIN tot ON tot.video_id = c.video_id),"""
    + PROJECT + " SELECT * FROM proj", "slide_changes_fx", "words_fx", "alignment_fx"))
def q_project(t):
    times = t.slide_changes().select("video_id", F.col("event_id").alias("time_id"), F.col("time_ms").alias("source_ms")).join(
        _totals(t), "video_id")
    out = timeline.project_time(times, t.alignment(), timeline.word_boundaries(t.words()), split=t.by_video)
    return out.select("video_id", "time_id", "projected_ms")


CAND = """
sp AS (SELECT video_id, slide_index, MIN(tts_start_ms) - 250 AS a, MAX(tts_end_ms) + 250 AS b FROM pairs GROUP BY 1, 2),
cw AS (SELECT s.video_id, s.slide_index, w.word_idx, w.normalized, w.start_ms, w.end_ms FROM sp s JOIN words_fx w ON w.video_id = s.video_id AND w.end_ms >= s.a AND w.start_ms <= s.b)"""


@query("candidate_words", with_fixtures(FLAGSHIP + "," + SLIDES + "," + CAND + " SELECT * FROM cw", *SLIDE_FX, "words_fx"))
def q_candidates(t):
    return timeline.candidate_words(_slides(t), t.alignment(), t.words())


@query("exact_phrase", with_fixtures(FLAGSHIP + "," + SLIDES + "," + CAND + """,
g AS (SELECT video_id, slide_index, 1 + slide_index % 8 AS n, list(normalized ORDER BY word_idx) AS ws, MIN(word_idx) AS m FROM cw GROUP BY video_id, slide_index),
ph AS (SELECT *, list_slice(ws, slide_index % 40 + 1, slide_index % 40 + n) AS p FROM g),
places AS (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM ph WHERE len(p) = n)
SELECT video_id, slide_index, m + MIN(k) - 1 AS start_word_index, m + MIN(k) - 1 + n - 1 AS end_word_index FROM places WHERE list_slice(ws, k, k + n - 1) = p GROUP BY video_id, slide_index, m, n""", *SLIDE_FX, "words_fx"))
def q_exact(t):
    cand = staged(timeline.candidate_words(_slides(t), t.alignment(), t.words()))
    n = 1 + F.col("slide_index") % 8
    first = cand.groupBy(*timeline.SLIDE).agg((F.min("word_idx") + F.col("slide_index") % 40).alias("a"))
    picked = cand.join(first, timeline.SLIDE).where(F.col("word_idx").between(F.col("a"), F.col("a") + n - 1)).groupBy(*timeline.SLIDE).agg(
        F.array_sort(F.collect_list(F.struct("word_idx", "normalized"))).alias("ws"))
    phrases = picked.where(F.size("ws") == n).select(*timeline.SLIDE, F.transform("ws", lambda w: w["normalized"]).alias("tokens"))
    return timeline.exact_phrases(phrases, cand)


@query("match_phrases")
def q_phrases(t):
    """Exact and fuzzy search in slide order; checked against a plain loop in the tests."""
    s = _slides(t)
    return timeline.match_phrases(s, timeline.candidate_words(s, t.alignment(), t.words()))


SEGMENTED = """
sub AS (SELECT s.*, COALESCE(NULLIF(trim(translated_text), ''), trim(text)) AS subtitle_text, window_start_ms, window_end_ms
        FROM slides s LEFT JOIN win w ON w.video_id = s.video_id AND w.slide_index = s.slide_index),
clip AS (SELECT *, slide_index = 1 AND subtitle_text = '' AS silent, CASE WHEN (slide_index = 1 AND subtitle_text = '') OR window_start_ms IS NULL THEN 0 ELSE GREATEST(0, window_start_ms) END AS c0,
                CASE WHEN (slide_index = 1 AND subtitle_text = '') OR window_end_ms IS NULL THEN 0 ELSE GREATEST(0, window_start_ms, window_end_ms) END AS c1 FROM sub),
seg AS (SELECT *, CASE WHEN silent THEN 2000 WHEN c1 > c0 THEN GREATEST(1200, CASE WHEN slide_index = 1 THEN 500 ELSE 0 END + c1 - c0 + 300) ELSE 1200 END AS duration_ms FROM clip),
tl AS (SELECT *, CAST(SUM(duration_ms) OVER (PARTITION BY video_id ORDER BY slide_index) AS BIGINT) AS video_end_ms FROM seg)"""


def _segmented(t):
    s = _slides(t)
    return timeline.timeline_segmented(s, timeline.slide_audio_window(s, t.alignment()), split=t.by_video)


@query("timeline_segmented", with_fixtures(FLAGSHIP + "," + SLIDES + "," + WINDOWS + "," + SEGMENTED + """
SELECT video_id, slide_index, event_id, bucket_id, subtitle_text, duration_ms, c0 AS audio_clip_start_ms, c1 AS audio_clip_end_ms, c1 - c0 AS audio_clip_duration_ms,
       video_end_ms, video_end_ms - duration_ms AS video_start_ms FROM tl""", *SLIDE_FX))
def q_segmented(t):
    return _segmented(t)


@query("shift_timeline", with_fixtures(FLAGSHIP + "," + SLIDES + "," + WINDOWS + "," + SEGMENTED + """
SELECT video_id, slide_index, video_end_ms - duration_ms + 800 AS video_start_ms, video_end_ms + 800 + CASE WHEN last THEN 3000 ELSE 0 END AS video_end_ms,
       duration_ms + CASE WHEN last THEN 3000 ELSE 0 END AS duration_ms, c0 + CASE WHEN c1 > c0 THEN 800 ELSE 0 END AS audio_clip_start_ms
FROM (SELECT *, slide_index = MAX(slide_index) OVER (PARTITION BY video_id) AS last FROM tl) q""", *SLIDE_FX))
def q_shift(t):
    out = timeline.shift_timeline(_segmented(t), 800, 3000, t.by_video)
    return out.select("video_id", "slide_index", "video_start_ms", "video_end_ms", "duration_ms", "audio_clip_start_ms")


CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"


@query("subtitle_cues", with_fixtures(FLAGSHIP + "," + SLIDES + "," + WINDOWS + "," + SEGMENTED + f"""
SELECT video_id, cue_no, a AS start_ms, b AS end_ms, text, cue_no || chr(10) || {CLOCK.format('a')} || ' --> ' || {CLOCK.format('b')} || chr(10) || text || chr(10) AS cue
FROM (SELECT video_id, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY slide_index) AS cue_no, trim(subtitle_text) AS text,
             CASE WHEN c1 > c0 THEN c0 ELSE video_end_ms - duration_ms END AS a, CASE WHEN c1 > c0 THEN c1 ELSE video_end_ms END AS b
      FROM tl WHERE trim(subtitle_text) <> '') q""", *SLIDE_FX))
def q_cues(t):
    return timeline.subtitle_cues(_segmented(t), t.by_video)


@query("timeline_master", with_fixtures(FLAGSHIP + "," + SLIDES + "," + WINDOWS + "," + SNAP + """,
tm AS (SELECT s.video_id, s.slide_index AS time_id, s.slide_end_ms AS source_ms, total_ms FROM slides s JOIN tot ON tot.video_id = s.video_id),""" + PROJECT + """,
inp AS (SELECT s.*, t.total_ms, COALESCE(NULLIF(trim(translated_text), ''), trim(text)) AS subtitle_text, w.window_start_ms AS ws, w.window_end_ms AS we, p.projected_ms AS pe,
               CASE WHEN s.slide_index % 3 = 0 THEN w.window_start_ms END AS ms, CASE WHEN s.slide_index % 3 = 0 THEN w.window_end_ms END AS me
        FROM slides s JOIN tot t ON t.video_id = s.video_id LEFT JOIN win w ON w.video_id = s.video_id AND w.slide_index = s.slide_index
        LEFT JOIN proj p ON p.video_id = s.video_id AND p.time_id = s.slide_index),
nx AS (SELECT *, LEAD(ms) OVER w AS nms, LEAD(1) OVER w IS NULL AS last, CASE WHEN FIRST_VALUE(subtitle_text) OVER w <> '' THEN 500 ELSE 2000 END AS off, slide_index = 1 AND subtitle_text = '' AS silent
       FROM inp WINDOW w AS (PARTITION BY video_id ORDER BY slide_index)),
ab AS (SELECT *, CASE WHEN silent THEN 2000 WHEN NOT last AND nms IS NOT NULL THEN 40 ELSE 1200 END AS a,
              CASE WHEN silent THEN NULL WHEN last THEN GREATEST(off + total_ms + 300, off + GREATEST(0, LEAST(total_ms, me)) + 300, off + GREATEST(0, LEAST(total_ms, pe)))
                   WHEN nms IS NOT NULL THEN off + GREATEST(0, LEAST(total_ms, nms)) WHEN me IS NOT NULL THEN off + GREATEST(0, LEAST(total_ms, me)) + 300
                   WHEN COALESCE(pe, we) IS NOT NULL THEN off + GREATEST(0, LEAST(total_ms, COALESCE(pe, we))) END AS b FROM nx),
rec AS (SELECT video_id, slide_index, 0 AS video_start_ms, GREATEST(a, COALESCE(b, 0)) AS video_end_ms FROM ab WHERE slide_index = 1
        UNION ALL SELECT x.video_id, x.slide_index, r.video_end_ms, GREATEST(r.video_end_ms + a, COALESCE(b, 0)) FROM rec r JOIN ab x ON x.video_id = r.video_id AND x.slide_index = r.slide_index + 1)
SELECT r.video_id, r.slide_index, r.video_start_ms, r.video_end_ms, subtitle_text,
       CASE WHEN silent THEN 0 WHEN ms IS NOT NULL THEN off + GREATEST(0, LEAST(total_ms, ms)) WHEN ws IS NOT NULL THEN off + GREATEST(0, LEAST(total_ms, ws)) ELSE video_start_ms END AS audio_clip_start_ms
FROM rec r JOIN ab ON ab.video_id = r.video_id AND ab.slide_index = r.slide_index""", *SLIDE_FX, "words_fx", recursive=True))
def q_master(t):
    s = _slides(t).join(_totals(t), "video_id")
    win = timeline.slide_audio_window(s, t.alignment())
    times = s.select("video_id", F.col("slide_index").alias("time_id"), F.col("slide_end_ms").alias("source_ms"), "total_ms")
    proj = timeline.project_time(times, t.alignment(), timeline.word_boundaries(t.words()), split=t.by_video).withColumnRenamed(
        "time_id", "slide_index")
    third = win.where("slide_index % 3 = 0").select(
        *timeline.SLIDE, F.col("window_start_ms").alias("match_start_ms"), F.col("window_end_ms").alias("match_end_ms"))
    out = timeline.timeline_master(s, third, proj, win, split=t.by_video)
    return out.select("video_id", "slide_index", "video_start_ms", "video_end_ms", "subtitle_text", "audio_clip_start_ms")


# -- consistency --------------------------------------------------------------

SEQ = r"""
ts AS (SELECT deck_id, slide_index, list_sort(list(DISTINCT n)) AS texts FROM (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM slide_elements_fx) q WHERE n <> '' GROUP BY 1, 2),
lg AS (SELECT *, LAG(texts) OVER (PARTITION BY deck_id ORDER BY slide_index) AS prev FROM ts),
rn AS (SELECT *, SUM(CASE WHEN prev IS NOT NULL AND list_has_all(texts, prev) AND len(texts) > len(prev) THEN 0 ELSE 1 END) OVER (PARTITION BY deck_id ORDER BY slide_index) AS run_no FROM lg),
sq AS (SELECT * FROM (SELECT deck_id, slide_index, run_no, COUNT(*) OVER (PARTITION BY deck_id, run_no) AS sequence_length, MAX(slide_index) OVER (PARTITION BY deck_id, run_no) AS reference_slide FROM rn) q WHERE sequence_length >= 2)"""
MAPPING = r"""
mp AS (SELECT o.deck_id, o.slide_index, lower(trim(regexp_replace(o.text, '\s+', ' ', 'g'))) AS original_norm, arg_max(trim(x.text), o.element_id) AS translated_text
       FROM slide_elements_fx o JOIN translated_elements_fx x ON x.deck_id = o.deck_id AND x.slide_index = o.slide_index AND x.element_id = o.element_id
       WHERE trim(o.text) <> '' AND trim(x.text) <> '' GROUP BY 1, 2, 3)"""
ISSUES = r"""
iss AS (SELECT x.deck_id, x.slide_index, s.run_no, x.element_id, m.original_norm AS original, m.translated_text AS expected, trim(x.text) AS got
        FROM translated_elements_fx x JOIN sq s ON s.deck_id = x.deck_id AND s.slide_index = x.slide_index AND s.slide_index <> s.reference_slide
        JOIN mp m ON m.deck_id = x.deck_id AND m.slide_index = s.reference_slide AND m.original_norm = lower(trim(regexp_replace(x.text, '\s+', ' ', 'g')))
        WHERE m.original_norm <> lower(trim(regexp_replace(m.translated_text, '\s+', ' ', 'g'))))"""
ELEMENTS = ("slide_elements_fx", "translated_elements_fx")


def _deck_hot(t):
    return t.split("documents", "doc_id")


def _sequences(t):
    return consistency.build_sequences(consistency.text_sets(t.slide_elements()), _deck_hot(t))


@query("text_sets", with_fixtures(SEQ + " SELECT deck_id, slide_index, array_to_string(texts, '|') AS texts FROM ts", *ELEMENTS))
def q_sets(t):
    return consistency.text_sets(t.slide_elements()).withColumn("texts", F.array_join("texts", "|"))


@query("build_sequences", with_fixtures(SEQ + """
SELECT deck_id, slide_index, CAST(run_no AS BIGINT) AS run_no, sequence_length, reference_slide FROM sq""", *ELEMENTS))
def q_sequences(t):
    return _sequences(t)


@query("strict_subset", with_fixtures(SEQ + """
SELECT deck_id, slide_index, prev IS NOT NULL AND list_has_all(texts, prev) AND len(texts) > len(prev) AS grows FROM lg""", *ELEMENTS))
def q_subset(t):
    s = OrderedScan(consistency.text_sets(t.slide_elements()), ["deck_id"], ["slide_index"]).lag("b", "texts").apply(_deck_hot(t))
    grows = F.coalesce(consistency.is_strict_subset(F.col("b"), F.col("texts")), F.lit(False))
    return s.select("deck_id", "slide_index", grows.alias("grows"))


def _mapping(t):
    return consistency.element_mapping(t.slide_elements(), t.translated_elements())


@query("element_mapping", with_fixtures(MAPPING + " SELECT * FROM mp", *ELEMENTS))
def q_mapping(t):
    return _mapping(t)


def _pairs(t):
    return consistency.element_pairs(t.slide_elements(), t.translated_elements())


INTERVALS = """
lp AS (SELECT o.deck_id, o.slide_index, trim(o.text) AS original, arg_max(trim(x.text), o.element_id) AS translated
       FROM slide_elements_fx o JOIN translated_elements_fx x ON x.deck_id = o.deck_id AND x.slide_index = o.slide_index AND x.element_id = o.element_id
       WHERE trim(o.text) <> '' AND trim(x.text) <> '' AND trim(o.text) <> trim(x.text) GROUP BY 1, 2, 3),
gi AS (SELECT deck_id, original, translated, LEAD(slide_index) OVER (PARTITION BY deck_id, original ORDER BY slide_index) AS valid_to, slide_index + 1 AS valid_from FROM lp)"""


@query("glossary_intervals", with_fixtures(INTERVALS + " SELECT * FROM gi", *ELEMENTS))
def q_intervals(t):
    return consistency.glossary_intervals(_pairs(t), _deck_hot(t))


@query("slide_glossary", with_fixtures(SEQ + "," + MAPPING + "," + INTERVALS + r""",
tx AS (SELECT DISTINCT deck_id, slide_index, trim(text) AS original FROM slide_elements_fx),
pl AS (SELECT t.*, s.reference_slide FROM tx t LEFT JOIN sq s ON s.deck_id = t.deck_id AND s.slide_index = t.slide_index)
SELECT p.deck_id, p.slide_index, p.original, m.translated_text AS translated, 'reference' AS origin FROM pl p JOIN mp m ON m.deck_id = p.deck_id AND m.slide_index = p.reference_slide
  AND m.original_norm = lower(trim(regexp_replace(p.original, '\s+', ' ', 'g')))
UNION ALL
SELECT p.deck_id, p.slide_index, p.original, g.translated, 'running' FROM pl p JOIN gi g ON g.deck_id = p.deck_id AND g.original = p.original
  AND p.slide_index >= g.valid_from AND (g.valid_to IS NULL OR p.slide_index <= g.valid_to) WHERE p.reference_slide IS NULL""", *ELEMENTS))
def q_slide_glossary(t):
    texts = t.slide_elements().select("deck_id", "slide_index", F.trim("text").alias("original")).distinct()
    return consistency.slide_glossary(texts, consistency.glossary_intervals(_pairs(t), _deck_hot(t)), _sequences(t), _mapping(t))


def _issues(t):
    return consistency.leftover_check(t.translated_elements(), _sequences(t), _mapping(t))


@query("leftover_check", with_fixtures(SEQ + "," + MAPPING + "," + ISSUES + """
SELECT deck_id, slide_index, CAST(run_no AS BIGINT) AS run_no, element_id, original, expected, got FROM iss""", *ELEMENTS))
def q_leftover(t):
    return _issues(t)


@query("consistency_report", with_fixtures(SEQ + "," + MAPPING + "," + ISSUES + """
SELECT s.deck_id, sequences_found, slides_in_sequences, COALESCE(n, 0) AS inconsistencies_found, COALESCE(m, 0) AS slides_with_issue
FROM (SELECT deck_id, COUNT(DISTINCT run_no) AS sequences_found, COUNT(*) AS slides_in_sequences FROM sq GROUP BY 1) s
LEFT JOIN (SELECT deck_id, COUNT(*) AS n, COUNT(DISTINCT slide_index) AS m FROM iss GROUP BY 1) i ON i.deck_id = s.deck_id""", *ELEMENTS))
def q_report(t):
    return consistency.consistency_report(_sequences(t), _issues(t))


@query("first_issues", with_fixtures(SEQ + "," + MAPPING + "," + ISSUES + """
SELECT deck_id, slide_index, arg_min('''' || original || ''' expected ''' || expected || ''' but got ''' || got || '''', (element_id, original)) AS description FROM iss GROUP BY 1, 2""", *ELEMENTS))
def q_first_issues(t):
    return consistency.first_issues(_issues(t))


@query("glossary_distinct", with_fixtures(SEQ + "," + MAPPING + """
SELECT m.deck_id, original_norm AS source, translated_text AS target, MIN(m.slide_index) AS first_slide
FROM mp m JOIN (SELECT DISTINCT deck_id, reference_slide FROM sq) r ON r.deck_id = m.deck_id AND r.reference_slide = m.slide_index GROUP BY 1, 2, 3""", *ELEMENTS))
def q_distinct(t):
    return consistency.distinct_pairs(_mapping(t), _sequences(t))
