"""Composite jobs as a user calls them, over the tables of the single queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import speech
from lectern.plans import jobs
from lectern.sources import readers
from lectern.suite import catalogue, decks, memory, playback
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import ORACLE, query


@query("job_deck_consistency", with_fixtures(playback.SEQ + "," + playback.MAPPING + "," + playback.ISSUES + """
SELECT d.deck_id, COALESCE(q, 0) AS sequences_found, COALESCE(k, 0) AS slides_in_sequences, COALESCE(n, 0) AS inconsistencies_found, COALESCE(m, 0) AS slides_with_issue
FROM (SELECT DISTINCT deck_id FROM slide_elements_fx) d
LEFT JOIN (SELECT deck_id, COUNT(DISTINCT run_no) AS q, COUNT(*) AS k FROM sq GROUP BY 1) s ON s.deck_id = d.deck_id
LEFT JOIN (SELECT deck_id, COUNT(*) AS n, COUNT(DISTINCT slide_index) AS m FROM iss GROUP BY 1) i ON i.deck_id = d.deck_id""", *playback.ELEMENTS))
def q_deck_consistency(t):
    """The report of all decks, those without a sequence too."""
    return jobs.deck_consistency(t.slide_elements(), t.translated_elements(), playback._deck_hot(t))["report"]


@query("job_glossary_application", ORACLE["slide_output_status"])
def q_glossary_application(t):
    return jobs.glossary_application(decks._slotted(t), decks._glossary_rows(t), ["slide_id"])[1]


@query("job_run_overview", ORACLE["run_catalog"])
def q_run_overview(t):
    items = t.upscale_items().withColumn("manifest_no", F.lit(1))
    out = jobs.run_overview(catalogue._files(t), items, readers.parse_config(catalogue._config(t)), catalogue._status(t))
    return out.select("run_id", "mtime", "highest_available", "cost_e7_usd", "upscale_mode_used", "status")


@query("job_translated_segments", with_fixtures(memory.translated_sql(12, 2800), "segments_fx", recursive=True))
def q_translation(t):
    s = memory.spoken_twice(t)
    rows, _after = jobs.translated_segments(s, _memory(s), memory.given_terms(t), memory.given_model(t, s), "German", F.lit(9).cast("bigint"))
    return rows.select("video_id", "segment_id", "translated_text", "translation_status", "termbase_hits")


def _memory(s):
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    return memory.given_memory(s).select(
        "source_text_norm", "target_language", F.col("source_text_norm").alias("source_text"), "target_text", F.lit("reviewed").alias("status"),
        none.alias("origin_run_id"), zero.alias("hit_count"), zero.alias("created_at"), zero.alias("updated_at"))


@query("job_memory_after", with_fixtures(memory.translated_sql(12, 2800).replace("SELECT video_id, segment_id, COALESCE(tm_text", """, out_ AS (SELECT video_id, segment_id, norm, start_ms, end_ms, COALESCE(tm_text""", 1).replace(
    "\nFROM fs", """ FROM fs),
new_ AS (SELECT norm, arg_max(translated_text, (CAST(video_id AS VARCHAR), start_ms, end_ms, segment_id)) AS t FROM out_ WHERE translation_status LIKE 'translated%' GROUP BY 1),
hit_ AS (SELECT norm, COUNT(*) AS n FROM out_ WHERE translation_status = 'tm_exact' GROUP BY 1),
all_ AS (SELECT COALESCE(n.norm, tm.norm) AS norm, COALESCE(n.t, tm.tgt) AS t, tm.norm IS NOT NULL AS old FROM new_ n FULL JOIN tm ON tm.norm = n.norm)
SELECT a.norm AS source_text_norm, a.t AS target_text, COALESCE(h.n, 0) AS hit_count FROM all_ a LEFT JOIN hit_ h ON h.norm = a.norm""", 1).replace(") AS translated_text,", ") AS translated_text,"), "segments_fx", recursive=True))
def q_memory_after(t):
    """The memory of a batch afterwards: what was written, and how often an entry was found."""
    s = memory.spoken_twice(t)
    _rows, after = jobs.translated_segments(s, _memory(s), memory.given_terms(t), memory.given_model(t, s), "German", F.lit(9).cast("bigint"))
    return after.select("source_text_norm", "target_text", "hit_count")


PLAN = """
seg AS (SELECT video_id, segment_id, trim(text) AS t, length(trim(text)) AS n, strlen(trim(text)) AS b, start_ms, end_ms,
               ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, segment_id) AS rn
        FROM segments_fx WHERE trim(text) <> ''),
whole AS (SELECT video_id, SUM(b) + COUNT(*) - 1 <= 3800 AND MAX(end_ms) - MIN(start_ms) <= 620000 AS single FROM seg GROUP BY 1),
fold AS (SELECT video_id, segment_id, rn, t, b AS own, 1 AS chunk_index, 1 AS cnt, n AS chars, b AS bytes FROM seg WHERE rn = 1
         UNION ALL
         SELECT s.video_id, s.segment_id, s.rn, s.t, s.b, CASE WHEN o.full_up THEN f.chunk_index + 1 ELSE f.chunk_index END,
                CASE WHEN o.full_up THEN 1 ELSE f.cnt + 1 END, CASE WHEN o.full_up THEN s.n ELSE f.chars + 1 + s.n END,
                CASE WHEN o.full_up THEN s.b ELSE f.bytes + 1 + s.b END
         FROM fold f JOIN seg s ON s.video_id = f.video_id AND s.rn = f.rn + 1,
         LATERAL (SELECT f.cnt >= 40 OR f.chars + 1 + s.n > 3200 OR f.bytes + 1 + s.b > 3800 AS full_up) o),
plan_ AS (SELECT f.video_id, CASE WHEN single THEN 1 ELSE chunk_index END AS chunk_index, CASE WHEN single THEN 'single_request' ELSE 'chapter_chunks' END AS mode,
                 bool_or(NOT single AND own > 3800) AS oversize, string_agg(CAST(segment_id AS VARCHAR), ';' ORDER BY rn) AS segment_ids, string_agg(t, ' ' ORDER BY rn) AS tts_text
          FROM fold f JOIN whole w ON w.video_id = f.video_id GROUP BY 1, 2, 3)"""


@query("job_speech_plan", with_fixtures(PLAN + " SELECT * FROM plan_", "segments_fx", recursive=True))
def q_speech_plan(t):
    out = jobs.speech_plan(t.segments().withColumn("translated_text", F.lit("")), 500)
    return out.withColumn("segment_ids", F.array_join(F.transform("segment_ids", lambda i: i.cast("string")), ";"))


# Speech of each chunk: as long as 300 ms a segment, heard word for word in two chunks of three, not at all in the third.
@query("job_speech_alignment", with_fixtures(playback.WEIGHTED.replace("(video_id * 7 + chunk_index * 5) % 23 AS total_words", "COUNT(*) * 3 AS total_words")
    .replace("MIN(start_ms) AS chunk_start_ms, MAX(end_ms) AS chunk_end_ms", "0 AS chunk_start_ms, 0 AS chunk_end_ms") + """,
tl AS (SELECT video_id, chunk_index, n * 300 AS d, CAST(SUM(n * 300) OVER (PARTITION BY video_id ORDER BY chunk_index) AS BIGINT) AS upto FROM ck),
up AS (SELECT a.*, upto - d AS c0, upto AS c1, SUM(words) OVER w AS cum, SUM(weight) OVER w AS cumw FROM al a JOIN tl ON tl.video_id = a.video_id AND tl.chunk_index = a.chunk_index
       WINDOW w AS (PARTITION BY a.video_id, a.chunk_index ORDER BY segment_id))
SELECT video_id, chunk_index, segment_id, start_ms AS source_start_ms, end_ms AS source_end_ms,
       CASE WHEN chunk_index % 3 <> 0 THEN c0 + (cum - words + 1) * 80 ELSE c0 + CAST(round_even((c1 - c0) * (cumw - weight) / w, 0) AS BIGINT) END AS tts_start_ms,
       CASE WHEN chunk_index % 3 <> 0 THEN c0 + cum * 80 + 60 ELSE c0 + CAST(round_even((c1 - c0) * cumw / w, 0) AS BIGINT) END AS tts_end_ms,
       CASE WHEN chunk_index % 3 <> 0 THEN 'asr_word_count' ELSE 'proportional' END AS alignment_mode, CASE WHEN chunk_index % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence
FROM up""", "segments_fx"))
def q_speech_alignment(t):
    s = t.segments().withColumns({"chunk_index": playback.idiv(F.col("segment_id") - 1, 3) + 1, "translated_text": F.lit("")})
    part = F.array_sort(F.collect_list(F.struct("segment_id", "text")))
    chunks = s.groupBy(*speech.CHUNK).agg(part.alias("ps")).select(
        *speech.CHUNK, F.transform("ps", lambda p: p["segment_id"]).alias("segment_ids"),
        F.array_join(F.transform("ps", lambda p: F.trim(p["text"])), " ").alias("tts_text"), F.lit("generated").alias("status"),
        (F.size("ps") * 300).cast("bigint").alias("duration_ms"))
    chunks = chunks.withColumn("asr_text", F.when(F.col("chunk_index") % 3 != 0, F.col("tts_text")).otherwise(""))
    words = chunks.select(*speech.CHUNK, F.explode(F.sequence(F.lit(1).cast("bigint"), 3 * F.size("segment_ids").cast("bigint"))).alias("word_no"))
    words = words.select(*speech.CHUNK, "word_no", (F.col("word_no") * 80).alias("start_ms"), (F.col("word_no") * 80 + 60).alias("end_ms"))
    out = jobs.speech_alignment(s.drop("chunk_index"), chunks, words, t.by_conversation)
    return out.select(*speech.CHUNK, "segment_id", "source_start_ms", "source_end_ms", "tts_start_ms", "tts_end_ms", "alignment_mode", "confidence")


PLAYED = playback.FLAGSHIP + "," + playback.SLIDES + "," + playback.WINDOWS + "," + playback.SEGMENTED + """,
sh AS (SELECT *, slide_index = MAX(slide_index) OVER (PARTITION BY video_id) AS last FROM tl),
pl AS (SELECT video_id, slide_index, event_id, video_end_ms - duration_ms + 700 AS video_start_ms, video_end_ms + 700 + CASE WHEN last THEN 1500 ELSE 0 END AS video_end_ms,
              c0 + CASE WHEN c1 > c0 THEN 700 ELSE 0 END AS clip0, c1 + CASE WHEN c1 > c0 THEN 700 ELSE 0 END AS clip1, trim(subtitle_text) AS subtitle_text FROM sh)"""


@query("job_playback", with_fixtures(PLAYED + """
SELECT p.video_id, p.slide_index, p.event_id, p.video_start_ms, p.video_end_ms, clip0 AS audio_clip_start_ms, clip1 AS audio_clip_end_ms, subtitle_text,
       CASE WHEN subtitle_text <> '' THEN COUNT(*) FILTER (WHERE subtitle_text <> '') OVER (PARTITION BY p.video_id ORDER BY slide_index) END AS cue_no,
       CASE WHEN subtitle_text <> '' THEN CASE WHEN clip1 > clip0 THEN clip0 ELSE video_start_ms END END AS cue_start_ms FROM pl p""", *playback.SLIDE_FX))
def q_playback(t):
    """Timeline with its cues, slide by slide, between an intro and an outro."""
    slides = playback._slides(t)
    rows, cues = jobs.playback(slides, t.alignment(), None, intro_ms=700, outro_ms=1500, split=t.by_video)
    starts = rows.where(F.trim("subtitle_text") != "").select(
        "video_id", "slide_index", F.row_number().over(Window.partitionBy("video_id").orderBy("slide_index")).cast("bigint").alias("cue_no"))
    own = rows.join(starts, ["video_id", "slide_index"], "left").join(
        cues.select("video_id", "cue_no", F.col("start_ms").alias("cue_start_ms")), ["video_id", "cue_no"], "left")
    return own.select("video_id", "slide_index", "event_id", "video_start_ms", "video_end_ms", "audio_clip_start_ms", "audio_clip_end_ms",
                      F.trim("subtitle_text").alias("subtitle_text"), "cue_no", "cue_start_ms")


RENDERED = decks.TO_R7 + "," + decks.NOISY + "," + decks.APPLIED + "," + decks.STYLED + """,
rs AS (SELECT a.deck_id, a.slide_id, a.unit_id, s.slot_id, s.fs, s.mode, a.x, a.y, GREATEST(1, a.w) AS w, GREATEST(1, a.h) AS h, a.x * 7 % 256 AS r, a.y * 3 % 256 AS g, a.w * 11 % 256 AS b
       FROM ap a JOIN st s ON s.slide_id = a.slide_id AND s.unit_id = a.unit_id WHERE outcome = 'resolved'),
cm AS (SELECT deck_id, slot_id, CAST(round_even(median(r), 0) AS BIGINT) AS mr, CAST(round_even(median(g), 0) AS BIGINT) AS mg, CAST(round_even(median(b), 0) AS BIGINT) AS mb FROM rs GROUP BY 1, 2)"""


def _rendered(t):
    rows = decks._slotted(t).withColumns({"r": F.col("x") * 7 % 256, "g": F.col("y") * 3 % 256, "b": F.col("w") * 11 % 256})
    styles = t.spark.createDataFrame(decks.STYLES, "level string, key string, name string, value string")
    return jobs.rendered_units(rows, decks._glossary_rows(t), styles, ["slide_id"], margin=30, split=decks._hot(t))


@query("job_rendered_units", with_fixtures(RENDERED + """
SELECT r.slide_id, r.unit_id, LEAST(48, fs) AS font_size, CASE WHEN mode = 'fixed' THEN LEAST(48, fs) ELSE GREATEST(8, LEAST(LEAST(48, fs), 12)) END AS min_font_size,
       mr || ';' || mg || ';' || mb AS rgb,
       EXISTS (SELECT 1 FROM ap o WHERE o.slide_id = r.slide_id AND o.unit_id <> r.unit_id AND r.x < o.x + GREATEST(1, o.w) + 60 AND o.x < r.x + r.w + 60
               AND r.y < o.y + GREATEST(1, o.h) + 60 AND o.y < r.y + r.h + 60) AS collides
FROM rs r JOIN cm ON cm.deck_id = r.deck_id AND cm.slot_id = r.slot_id""", "ocr_units_fx", "text_lines_fx"))
def q_rendered(t):
    """Resolved units with style, colour and collisions."""
    out = _rendered(t)["units"]
    return out.select("slide_id", "unit_id", "font_size", "min_font_size", F.array_join("text_color_rgb", ";").alias("rgb"), "collides")


@query("job_render_counters", with_fixtures(RENDERED + """
SELECT deck_id, COUNT(*) AS unit_count, COUNT(*) FILTER (WHERE outcome = 'resolved') AS resolved_count, COUNT(*) FILTER (WHERE outcome = 'identical') AS identical_count,
       COUNT(*) FILTER (WHERE outcome = 'missing_glossary_match') AS missing_count, COUNT(*) FILTER (WHERE outcome = 'empty_target_text') AS empty_count
FROM ap GROUP BY 1""", "ocr_units_fx", "text_lines_fx"))
def q_render_counters(t):
    return _rendered(t)["counters"]


@query("job_slide_glossary", ORACLE["slide_glossary"])
def q_slide_glossary(t):
    """The glossary each slide of a deck goes by, as the consistency job gives it."""
    return jobs.deck_consistency(t.slide_elements(), t.translated_elements(), playback._deck_hot(t))["slide_glossary"]


@query("job_run_readiness", ORACLE["run_readiness"].replace("SELECT *, CASE WHEN video_export_ready", """,
k AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem)
SELECT run_id, final_slides_ready, translated_text_ready, tts_ready, array_to_string(list_filter([CASE WHEN NOT final_slides_ready THEN 'final slides' END, CASE WHEN NOT tts_ready THEN 'speech' END], lambda x: x IS NOT NULL), ';') AS missing FROM f JOIN k USING (run_id)
--""", 1).split("--")[0])
def q_run_readiness(t):
    """The catalogue of runs with what each still lacks for a video."""
    items = t.upscale_items().withColumn("manifest_no", F.lit(1))
    out = jobs.run_overview(
        catalogue._files(t), items, readers.parse_config(catalogue._config(t)), catalogue._status(t), catalogue.level_parts(t),
        {"final slides": F.col("final_slides_ready"), "speech": F.col("tts_ready")})
    return out.select("run_id", "final_slides_ready", "translated_text_ready", "tts_ready", F.array_join("missing_requirements", ";").alias("missing"))
