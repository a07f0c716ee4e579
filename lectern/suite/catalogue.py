"""Queries over runs, files, logs and serialized inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import runs
from lectern.sources import readers, sinks
from lectern.streaming import steps
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query

# -- costs and artifacts --------------------------------------------------------


@query("cost_summary", with_fixtures("""
SELECT run_id, COUNT(*) AS items_processed, COUNT(*) FILTER (WHERE status = 'upscaled') AS upscaled, COUNT(*) FILTER (WHERE status <> 'upscaled') AS fallback,
       CAST(SUM(predict_ms) AS BIGINT) AS predict_ms, CAST(SUM(cost_e7_usd) AS BIGINT) AS cost_e7_usd FROM upscale_items_fx GROUP BY 1""", "upscale_items_fx"))
def q_cost(t):
    return runs.manifest_summary(t.upscale_items(), ["run_id"])


@query("run_cost", with_fixtures("""
SELECT run_id, arg_min(provider, manifest_no) AS provider, COUNT(*) AS manifest_count, CAST(SUM(c) AS BIGINT) AS cost_e7_usd
FROM (SELECT run_id, item_no % 2 AS manifest_no, MIN(provider) AS provider, SUM(cost_e7_usd) AS c FROM upscale_items_fx GROUP BY 1, 2) q GROUP BY 1""", "upscale_items_fx"))
def q_run_cost(t):
    return runs.run_cost(t.upscale_items().withColumn("manifest_no", F.col("item_no") % 2))


@query("stored_summaries", with_fixtures("""
SELECT o_orderkey AS run_id, COALESCE(n, o_custkey % 3 + 5) AS items_processed, COALESCE(u, 0) AS upscaled, COALESCE(f, 0) AS fallback, COALESCE(c, 77) AS cost_e7_usd
FROM orders LEFT JOIN (SELECT run_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'upscaled') AS u, COUNT(*) FILTER (WHERE status <> 'upscaled') AS f, CAST(SUM(cost_e7_usd) AS BIGINT) AS c
  FROM upscale_items_fx GROUP BY 1) q ON q.run_id = o_orderkey""", "upscale_items_fx"))
def q_stored(t):
    zero = F.lit(0).cast("bigint")
    stored = t.base("orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 3 + 5).cast("bigint").alias("items_processed"),
        zero.alias("upscaled"), zero.alias("fallback"), F.lit(77).cast("bigint").alias("cost_e7_usd"))
    keys = t.base("orders").select(F.col("o_orderkey").alias("run_id"))
    derived = runs.manifest_summary(t.upscale_items().join(keys, "run_id", "left_semi"), ["run_id"]).drop("predict_ms")
    return runs.merge_summaries(stored, derived, ["run_id"])


@query("predict_cost", with_fixtures("""
SELECT run_id, item_no, predict_ms, CAST(round_even(GREATEST(0, predict_ms) * 225 / CAST(1000.0 AS DOUBLE), 0) AS BIGINT) * 10 AS cost FROM upscale_items_fx""", "upscale_items_fx"))
def q_predict(t):
    return t.upscale_items().select("run_id", "item_no", "predict_ms", runs.predict_cost_e7(F.col("predict_ms")).alias("cost"))


KINDS = [level for level, _t in runs.ARTIFACT_LEVELS]
FILES = """
files AS (SELECT l_orderkey AS run_id, [""" + ", ".join(f"'{k}'" for k in KINDS) + """, 'other'][l_partkey % 8 + 1] AS kind, epoch_ms(l_shipdate) // 1000 AS mtime,
                 'f' || l_partkey || CASE WHEN l_suppkey % 3 = 0 THEN '.MP4' ELSE '.png' END AS name FROM lineitem)"""
COUNTS = """
counts AS (SELECT run_id, """ + ", ".join(f"COUNT(*) FILTER (WHERE kind = '{k}') AS {k}" for k in KINDS) + """, MAX(mtime) AS mtime FROM files GROUP BY 1)"""


def _files(t):
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "other"]])
    return t.base("lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.element_at(kinds, (F.col("l_partkey") % 8 + 1).cast("int")).alias("kind"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 3 == 0, ".MP4").otherwise(".png")).alias("name"))


@query("artifact_counts", ("WITH" + FILES + "," + COUNTS + " SELECT * FROM counts"))
def q_artifacts(t):
    return runs.artifact_counts(_files(t), KINDS)


HIGHEST = "CASE " + " ".join(f"WHEN {k} > 0 THEN '{k}'" for k in reversed(KINDS)) + " ELSE 'none' END"


@query("highest_artifact", ("WITH" + FILES + "," + COUNTS + f" SELECT run_id, {HIGHEST} AS highest_available, tts > 0 AS tts_ready FROM counts"))
def q_highest(t):
    return runs.highest_artifact(runs.artifact_counts(_files(t), KINDS)).select("run_id", "highest_available", "tts_ready")


PARTS = sorted({p for g in (runs.LEVEL_PARTS, runs.ANY_PARTS, runs.SIDE_PARTS) for ps in g.values() for p in ps})


@query("run_readiness", "WITH parts AS (SELECT l_orderkey AS run_id, " + str([*PARTS, "other"]) + """[(l_partkey + l_linenumber) % 11 + 1] AS part, l_suppkey % 3 AS n FROM lineitem),
c AS (SELECT run_id, """ + ", ".join(f"COALESCE(SUM(n) FILTER (part = '{p}'), 0) AS {p}" for p in PARTS) + """ FROM parts GROUP BY 1),
f AS (SELECT run_id, base_table > 0 AS base_events_ready, final_table > 0 AND final_images > 0 AS final_slides_ready, translated_images > 0 AS translated_slides_ready,
             upscaled_images > 0 AS upscaled_slides_ready, translated_upscaled_images > 0 AS translated_upscaled_slides_ready, translated_table > 0 AS translated_text_ready,
             alignment_table > 0 OR audio_files > 0 AS tts_ready, video_files > 0 AS video_export_ready FROM c)
SELECT *, CASE WHEN video_export_ready THEN 'video_export' WHEN tts_ready THEN 'tts' WHEN translated_upscaled_slides_ready THEN 'translated_upscaled_slides'
               WHEN upscaled_slides_ready THEN 'upscaled_slides' WHEN translated_slides_ready THEN 'translated_slides' WHEN final_slides_ready THEN 'final_slides'
               WHEN base_events_ready THEN 'base_events' ELSE 'none' END AS highest_available FROM f""")
def q_readiness(t):
    """Levels from tables and folders; a table or folder may be there and empty."""
    return runs.run_readiness(level_parts(t)).drop("highest_available_label")


def level_parts(t):
    part = F.element_at(F.array(*[F.lit(p) for p in [*PARTS, "other"]]), ((F.col("l_partkey") + F.col("l_linenumber")) % 11 + 1).cast("int"))
    return t.base("lineitem").select(F.col("l_orderkey").alias("run_id"), part.alias("part"), (F.col("l_suppkey") % 3).alias("n"))


@query("missing_requirements", ("WITH" + FILES + "," + COUNTS + """
SELECT run_id, array_to_string(list_filter([CASE WHEN final_slides = 0 THEN 'final slide images' END, CASE WHEN tts = 0 THEN 'speech' END, CASE WHEN base_events = 0 THEN 'slide map' END], lambda x: x IS NOT NULL), ';') AS missing,
       final_slides > 0 AND tts > 0 AND base_events > 0 AS ready FROM counts"""))
def q_missing(t):
    out = runs.missing_requirements(runs.artifact_counts(_files(t), KINDS), {
        "final slide images": F.col("final_slides") > 0, "speech": F.col("tts") > 0, "slide map": F.col("base_events") > 0})
    return out.select("run_id", F.array_join("missing_requirements", ";").alias("missing"), "ready")


@query("newest_file", ("WITH" + FILES + """
SELECT run_id, arg_max(name, (mtime, name)) AS name FROM files WHERE lower(name) LIKE '%.mp4' GROUP BY 1"""))
def q_newest(t):
    return runs.newest_file(_files(t), ["run_id"], ".mp4")


@query("latest_run", ("WITH" + FILES + """
SELECT kind, arg_max(run_id, (mtime, run_id)) AS run_id, MAX(mtime) AS mtime FROM files GROUP BY 1"""))
def q_latest(t):
    return runs.latest_run(_files(t), ["kind"])


@query("run_preview", ("WITH" + FILES + "," + COUNTS + " SELECT run_id, mtime FROM counts ORDER BY mtime DESC, run_id DESC LIMIT 20"))
def q_preview(t):
    """The newest twenty runs, as a list shows them."""
    rows = runs.artifact_counts(_files(t), KINDS).select("run_id", "mtime")
    return rows.orderBy(F.col("mtime").desc(), F.col("run_id").desc()).limit(20)


CONFIG = """
cfg AS (SELECT l_orderkey AS run_id, arg_max('m' || l_suppkey, (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey) AS mode FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1)"""


def _config(t):
    """Settings of each run as text lines."""
    key = F.when(F.col("l_linenumber") == 2, "# FINAL_SLIDE_UPSCALE_MODE").otherwise(" FINAL_SLIDE_UPSCALE_MODE ")
    line = F.concat(key, F.lit('="m'), F.col("l_suppkey").cast("string"), F.lit('"'))
    at = (F.col("l_linenumber").cast("bigint") * 10000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")
    return t.base("lineitem").select(F.col("l_orderkey").alias("run_id"), at.alias("line_no"), line.alias("line"))


@query("read_config", """
SELECT l_orderkey AS run_id, (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey AS line_no, 'FINAL_SLIDE_UPSCALE_MODE' AS key, 'm' || l_suppkey AS value FROM lineitem WHERE l_linenumber <> 2""")
def q_config(t):
    return readers.parse_config(_config(t))


def _status(t):
    return t.base("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))


@query("run_catalog", with_fixtures(FILES + "," + COUNTS + "," + CONFIG + f""",
cost AS (SELECT run_id, CAST(SUM(cost_e7_usd) AS BIGINT) AS c FROM upscale_items_fx GROUP BY 1)
SELECT n.run_id, mtime, {HIGHEST} AS highest_available, COALESCE(c, 0) AS cost_e7_usd, COALESCE(mode, '') AS upscale_mode_used, COALESCE(o_orderstatus, '') AS status
FROM counts n LEFT JOIN cost ON cost.run_id = n.run_id LEFT JOIN cfg ON cfg.run_id = n.run_id LEFT JOIN orders ON o_orderkey = n.run_id""", "upscale_items_fx"))
def q_catalog(t):
    costs = runs.manifest_summary(t.upscale_items(), ["run_id"]).select("run_id", "cost_e7_usd")
    out = runs.run_catalog(runs.artifact_counts(_files(t), KINDS), costs, readers.parse_config(_config(t)), _status(t))
    return out.select("run_id", "mtime", "highest_available", "cost_e7_usd", "upscale_mode_used", "status")


# -- assets and views -------------------------------------------------------------


def _assets(t):
    d = F.element_at(F.array(*[F.lit(v) for v in ("full", "slide", "slide_translated", "raw")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return t.base("lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("event_id"), d.alias("directory"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"))


ASSETS = """
assets AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS event_id, ['full', 'slide', 'slide_translated', 'raw'][l_suppkey % 4 + 1] AS directory, 'p' || l_partkey AS name FROM lineitem)"""


@query("pick_asset", ("WITH" + ASSETS + """
SELECT run_id, event_id, arg_min(directory, (k, name)) AS directory, arg_min(name, (k, name)) AS name
FROM (SELECT *, list_position(['slide_translated', 'slide', 'full'], directory) AS k FROM assets) q WHERE k IS NOT NULL GROUP BY 1, 2"""))
def q_asset(t):
    return runs.pick_asset(_assets(t), ["run_id", "event_id"], ["slide_translated", "slide", "full"])


@query("base_events", "WITH" + ASSETS + """,
ch AS (SELECT l_orderkey AS run_id, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_linenumber END AS event_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS index, l_quantity AS q
       FROM lineitem),
pc AS (SELECT run_id, event_id, arg_min(directory, (k, name)) AS directory, arg_min(name, (k, name)) AS name
       FROM (SELECT *, list_position(CASE WHEN event_id = 1 THEN ['full', 'slide'] ELSE ['slide', 'full'] END, directory) AS k FROM assets) q WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT c.run_id, c.event_id, c.index, c.q, COALESCE(directory || '/' || name, '') AS image_path, COALESCE(name, '') AS image_name
FROM ch c LEFT JOIN pc p ON p.run_id = c.run_id AND p.event_id = c.event_id WHERE c.event_id > 0""")
def q_base_events(t):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.base("lineitem").select(
        F.col("l_orderkey").alias("run_id"), place.alias("row_no"),
        F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(F.col("l_linenumber")).cast("bigint").alias("event_id"), F.col("l_quantity").alias("q"))
    return runs.base_events_view(rows, _assets(t))


def _overrides(t):
    mode = F.element_at(F.array(*[F.lit(v) for v in ("slide", "full", "auto")]), (F.col("l_partkey") % 3 + 1).cast("int"))
    event = F.when(F.col("l_partkey") % 11 == 0, F.lit("x")).otherwise(F.col("l_linenumber").cast("string"))
    rows = t.base("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber")).agg(F.max("l_partkey").alias("l_partkey"))
    return rows.select("run_id", event.alias("event_id"), mode.alias("mode"))


OVERRIDES = """
ov AS (SELECT run_id, event_id, mode FROM (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS event_id, MAX(l_partkey) AS pk, ['slide', 'full', 'auto'][MAX(l_partkey) % 3 + 1] AS mode FROM lineitem GROUP BY 1, 2) q
       WHERE pk % 11 <> 0 AND mode <> 'auto')"""


@query("apply_overrides", ("WITH" + OVERRIDES + " SELECT * FROM ov"))
def q_overrides(t):
    return runs.usable_overrides(_overrides(t))


VIEW = """
base AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS event_id, MAX(l_comment_like) AS text FROM (SELECT *, 'e' || l_linenumber AS l_comment_like FROM lineitem) q GROUP BY 1, 2),
has AS (SELECT run_id, event_id, bool_or(directory = 'slide') AS hs, bool_or(directory = 'full') AS hf FROM assets GROUP BY 1, 2),
vw AS (SELECT b.run_id, b.event_id, hs, hf, o.mode, CASE WHEN b.event_id % 2 = 0 THEN 'tr ' || b.text ELSE '' END AS translated_text, CASE WHEN b.event_id % 3 = 0 THEN 'note' ELSE '' END AS translation_note,
              CASE WHEN b.event_id = 1 AND hf THEN 'full' WHEN b.event_id <> 1 AND hs THEN 'slide' WHEN hs THEN 'slide' WHEN hf THEN 'full' ELSE '' END AS dm
       FROM base b LEFT JOIN has h ON h.run_id = b.run_id AND h.event_id = b.event_id LEFT JOIN ov o ON o.run_id = b.run_id AND o.event_id = b.event_id)"""


@query("final_slide_view", ("WITH" + ASSETS + "," + OVERRIDES + "," + VIEW + """
SELECT run_id, event_id, translated_text, translation_note, dm AS default_image_mode, CASE WHEN mode = 'slide' AND hs THEN 'slide' WHEN mode = 'full' AND hf THEN 'full' ELSE dm END AS image_mode FROM vw"""))
def q_view(t):
    slides = t.base("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("event_id")).distinct()
    tr = slides.where("event_id % 2 = 0").withColumn("translated_text", F.concat(F.lit("tr e"), F.col("event_id").cast("string")))
    notes = slides.where("event_id % 3 = 0").withColumn("note", F.lit("note"))
    out = runs.final_slide_view(slides, _assets(t), _overrides(t), tr, notes)
    return out.select("run_id", "event_id", "translated_text", "translation_note", "default_image_mode", "image_mode")


@query("resolve_image_mode", ("WITH" + ASSETS + "," + OVERRIDES + "," + VIEW + """
SELECT run_id, event_id, dm AS default_image_mode, CASE WHEN mode = 'slide' AND hs THEN 'slide' WHEN mode = 'full' AND hf THEN 'full' ELSE dm END AS image_mode FROM vw"""))
def q_mode(t):
    a = _assets(t).groupBy("run_id", "event_id").agg(
        F.bool_or(F.col("directory") == "slide").alias("s"), F.bool_or(F.col("directory") == "full").alias("f"))
    o = runs.usable_overrides(_overrides(t)).select("run_id", "event_id", "mode")
    default, mode = runs.resolve_image_mode(F.col("event_id"), F.col("s"), F.col("f"), F.col("mode"))
    return a.join(o, ["run_id", "event_id"], "left").select(
        "run_id", "event_id", default.alias("default_image_mode"), mode.alias("image_mode"))


@query("slide_metadata", """
SELECT l_orderkey AS run_id, l_partkey AS event_id, CASE WHEN e.i IS NULL THEN l_linenumber ELSE e.i END AS slide_index
FROM lineitem l LEFT JOIN (SELECT l_orderkey AS o, l_partkey AS p, MIN(l_suppkey) AS i FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2) e ON e.o = l_orderkey AND e.p = l_partkey""")
def q_metadata(t):
    li = t.base("lineitem")
    events = li.where("l_partkey % 2 = 0").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("event_id")).agg(
        F.min("l_suppkey").alias("slide_index"))
    images = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("event_id"), F.col("l_linenumber").cast("bigint").alias("position"))
    return runs.slide_metadata(images, events).select("run_id", "event_id", "slide_index")


@query("resume_pending", with_fixtures("""
SELECT DISTINCT run_id, item_no FROM upscale_items_fx u WHERE NOT EXISTS (
  SELECT 1 FROM upscale_items_fx m WHERE m.run_id = u.run_id AND m.item_no = u.item_no AND m.status = 'upscaled'
    AND EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = m.run_id AND f.l_linenumber = m.item_no AND f.l_partkey % 3 <> 0))""", "upscale_items_fx"))
def q_resume(t):
    files = t.base("lineitem").where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("item_no"))
    items = t.upscale_items().select("run_id", "item_no").distinct()
    return runs.resume_pending(items, t.upscale_items(), files, ["run_id", "item_no"], ["upscaled"])


@query("edit_eligibility", """
SELECT l_orderkey, l_partkey, l_linenumber AS slide_index,
       CASE WHEN l_linenumber <= 1 THEN 'skipped' WHEN l_returnflag = 'R' THEN 'skipped' WHEN l_partkey % 5 = 0 THEN 'fallback' WHEN l_suppkey % 2 = 0 THEN 'skipped' END AS status,
       CASE WHEN l_linenumber <= 1 THEN 'skip_window' WHEN l_returnflag = 'R' THEN 'full_source' WHEN l_partkey % 5 = 0 THEN 'read_failed' WHEN l_suppkey % 2 = 0 THEN 'no_mask' END AS reason
FROM lineitem""")
def q_edit(t):
    rows = t.base("lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("slide_index"),
        F.when(F.col("l_returnflag") == "R", "full").otherwise("slide").alias("source_mode"),
        (F.col("l_partkey") % 5 != 0).alias("readable"), (F.col("l_suppkey") % 2 != 0).alias("has_mask"))
    return runs.edit_eligibility(rows).select("l_orderkey", "l_partkey", "slide_index", "status", "reason")


@query("pick_attempt", """
SELECT o AS run_id, MIN(a) FILTER (WHERE p) AS accepted_attempt, CASE WHEN bool_or(p) THEN 'edited' ELSE 'fallback' END AS status, CASE WHEN NOT bool_or(p) THEN arg_max(r, a) END AS reason
FROM (SELECT l_orderkey AS o, l_linenumber AS a, bool_or(l_discount < 0.02) AS p, 'q' || MIN(l_suppkey) AS r FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) q GROUP BY 1""")
def q_attempt(t):
    attempts = t.base("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("attempt")).agg(
        F.bool_or(F.col("l_discount") < 0.02).alias("passed"), F.concat(F.lit("q"), F.min("l_suppkey").cast("string")).alias("reason"))
    return runs.pick_attempt(attempts, ["run_id"], 3)


@query("provider_gate", """
WITH c AS (SELECT conv_id, COUNT(*) FILTER (WHERE trim(text) <> '') AS n FROM conversations GROUP BY 1)
SELECT user_id AS run_id, COALESCE(n, 0) AS segment_count,
       CASE WHEN user_id % 4 = 0 THEN CASE user_id % 3 WHEN 0 THEN 'fallback_unavailable' WHEN 1 THEN 'fallback_unavailable' ELSE 'failed' END
            WHEN COALESCE(n, 0) = 0 THEN 'fallback_empty' ELSE 'kept' END AS decision
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c ON conv_id = user_id""")
def q_gate(t):
    m = F.col("run_id") % 3
    ids = t.base("events").select(F.col("user_id").alias("run_id")).distinct().withColumns({
        "exit_code": F.when(F.col("run_id") % 4 == 0, 1).otherwise(0),
        "message": F.when(m == 0, "rpc permission_denied").when(m == 1, "API has not been used before or it is disabled").otherwise("timeout")})
    s = t.base("conversations").select(F.col("conv_id").alias("run_id"), "text", F.lit(None).cast("string").alias("translated_text"))
    return runs.provider_gate(ids, s).select("run_id", "segment_count", "decision")


# Fixed language rows of the query.
LANGUAGES = [("English", "en-US", "", "GA"), ("Deutsch", "de-DE", "", "GA"), ("Français", "fr-FR", "fr", "GA"),
             ("中文", "cmn-CN", "", "Preview"), ("", "xx", "", ""), ("Kein Code", "", "", "")]


@query("resolve_language", """
SELECT doc_id, label, CASE label WHEN 'English' THEN 'en' WHEN 'Deutsch' THEN 'de' WHEN 'Français' THEN 'fr' WHEN '中文' THEN 'zh-CN' END AS translate_language_code, label = 'Klingon' AS unknown_language
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '中文' WHEN lang = 'en' THEN 'English' WHEN lang = 'de' THEN 'Deutsch' WHEN lang = 'fr' THEN 'Français' ELSE 'Klingon' END AS label FROM documents) d""")
def q_language(t):
    rows = t.spark.createDataFrame(
        LANGUAGES, "label string, tts_language_code string, translate_language_code string, launch_readiness string")
    lang = F.col("lang")
    label = (F.when(F.col("doc_id") % 10 == 9, "中文").when(lang == "en", "English").when(lang == "de", "Deutsch")
             .when(lang == "fr", "Français").otherwise("Klingon"))
    docs = t.base("documents").select("doc_id", label.alias("label"))
    return runs.resolve_language(docs, readers.clean_languages(rows), "label").select(
        "doc_id", "label", "translate_language_code", "unknown_language")


@query("image_ratio", with_fixtures("""
SELECT slide_id, unit_id, round((w + 10) / w, 4) AS width_ratio, round((h * 2) / h, 4) AS height_ratio, printf('%.1f KiB', w * h / 1024.0) AS size_text FROM ocr_units_fx""", "ocr_units_fx"))
def q_ratio(t):
    u = t.ocr_units().select(
        "slide_id", "unit_id", F.col("w").alias("width"), F.col("h").alias("height"), (F.col("w") * F.col("h")).alias("bytes"),
        (F.col("w") + 10).alias("candidate_width"), (F.col("h") * 2).alias("candidate_height"), F.col("w").alias("candidate_bytes"))
    return runs.image_ratio(u).select("slide_id", "unit_id", "width_ratio", "height_ratio", "size_text")


@query("roi_of", """
SELECT o_orderkey, 10 + c_nationkey AS x0, 900 AS x1 FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def q_roi(t):
    videos = t.base("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("video"))
    regions = t.base("customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("video"), (10 + F.col("c_nationkey")).alias("x0"),
        F.lit(20).alias("y0"), F.lit(900).alias("x1"), F.lit(700).alias("y1"))
    return runs.roi_of(videos, regions).select("o_orderkey", "x0", "x1")


# -- logs -----------------------------------------------------------------------

PARSED = r"""
mk AS (SELECT run_id, line_no, regexp_extract(line, '^@@STEP\s+(START|DONE|SKIP|DETAIL)\s+([a-z0-9-]+)(?:\s+(.*))?$', 1) AS action, regexp_extract(line, '^@@STEP\s+(START|DONE|SKIP|DETAIL)\s+([a-z0-9-]+)(?:\s+(.*))?$', 2) AS step_id,
              regexp_extract(line, '^@@STEP\s+(START|DONE|SKIP|DETAIL)\s+([a-z0-9-]+)(?:\s+(.*))?$', 3) AS detail FROM step_log_fx)"""
STATE = """
st AS (SELECT run_id, step_id, COALESCE(CASE arg_max(action, line_no) FILTER (WHERE action <> 'DETAIL') WHEN 'START' THEN 'running' WHEN 'DONE' THEN 'done' WHEN 'SKIP' THEN 'skipped' END, 'running') AS status,
              arg_max(detail, line_no) AS detail, COALESCE(MAX(line_no) FILTER (WHERE action IN ('START', 'DETAIL')), 0) AS touch_line
       FROM mk WHERE action <> '' AND step_id <> 'unknown-step' GROUP BY 1, 2),
cu AS (SELECT run_id, CASE WHEN arg_max(status, touch_line) FILTER (WHERE touch_line > 0) = 'running' THEN arg_max(step_id, touch_line)
                           ELSE arg_min(step_id, list_position(['transcription', 'translate', 'tts', 'video-export'], step_id)) FILTER (WHERE status = 'running') END AS current_step FROM st GROUP BY 1)"""


@query("read_step_log", with_fixtures(PARSED + """
SELECT run_id, line_no, action, step_id, detail, step_id <> 'unknown-step' AS step_known FROM mk WHERE action <> ''""", "step_log_fx"))
def q_log(t):
    return steps.parse_markers(t.step_log())


@query("step_state", with_fixtures(PARSED + "," + STATE + " SELECT * FROM st", "step_log_fx"))
def q_state(t):
    return steps.step_state(t.step_log())


@query("current_step", with_fixtures(PARSED + "," + STATE + " SELECT * FROM cu", "step_log_fx"))
def q_current(t):
    return steps.current_step(steps.step_state(t.step_log())).select("run_id", "current_step")


@query("finalize_run", with_fixtures(PARSED + "," + STATE + """,
en AS (SELECT run_id, current_step, CASE WHEN run_id % 5 = 0 THEN 'stopped' WHEN run_id % 3 = 0 THEN 'error' ELSE 'done' END AS status FROM cu)
SELECT run_id, status, current_step, CASE WHEN current_step IS NOT NULL THEN status END AS step_status, CASE WHEN status = 'error' THEN current_step END AS error_step FROM en""", "step_log_fx"))
def q_finalize(t):
    state = steps.step_state(t.step_log())
    ends = state.select("run_id").distinct().withColumns({
        "exit_code": F.when(F.col("run_id") % 3 == 0, 1).otherwise(0), "stop_requested": F.col("run_id") % 5 == 0})
    return steps.finalize_runs(state, ends)


@query("effective_status", with_fixtures(PARSED + "," + STATE + """
SELECT c.run_id, CASE WHEN c.run_id % 3 = 0 THEN 'running' WHEN c.run_id % 2 = 0 THEN 'done' ELSE '' END AS status,
       CASE WHEN c.run_id % 3 = 0 THEN COALESCE(current_step, '') ELSE '' END AS current_step FROM cu c""", "step_log_fx"))
def q_effective(t):
    cur = steps.current_step(steps.step_state(t.step_log())).drop("current_detail")
    live = cur.where("run_id % 3 = 0").withColumn("status", F.lit("running"))
    recorded = cur.where("run_id % 2 = 0").select("run_id", F.lit("done").alias("status"), F.lit("").alias("current_step"))
    return steps.effective_status(cur.select("run_id"), live, recorded)


# -- serialized inputs --------------------------------------------------------------


@query("parse_llm_json", """
SELECT conv_id, turn AS index, CASE WHEN turn % 5 = 4 OR conv_id % 9 = 8 THEN NULL WHEN turn % 7 = 6 THEN '' ELSE 'x ' || text END AS translated_text,
       CASE WHEN conv_id % 9 = 8 THEN 'unreadable' WHEN turn % 5 = 4 THEN 'missing' WHEN turn % 7 = 6 THEN 'empty' ELSE 'ok' END AS status
FROM conversations""")
def q_llm(t):
    """Answers written as fenced, wrapped, bare or broken JSON, and read back."""
    c = t.base("conversations")
    item = F.struct(F.col("turn").alias("index"), F.when(F.col("turn") % 7 == 6, " ").otherwise(F.concat(F.lit("x "), F.col("text"))).alias("translated_text"))
    items = F.array_sort(F.collect_list(F.when(F.col("turn") % 5 != 4, item)))
    k = F.col("conv_id") % 9
    rows = c.groupBy("conv_id").agg(items.alias("i")).select("conv_id", "i", F.to_json("i").alias("bare"),
                                                             F.to_json(F.struct(F.col("i").alias("translations"))).alias("wrapped"))
    raw = (F.when(k == 8, F.lit("no answer")).when(k < 3, F.concat(F.lit("```json\n"), F.col("wrapped"), F.lit("\n```")))
           .when(k < 6, F.col("wrapped")).otherwise(F.col("bare")))
    return readers.parse_llm_json(rows.select("conv_id", raw.alias("raw")), c.select("conv_id", F.col("turn").alias("index")), ["conv_id"])


@query("read_segments", """
SELECT conv_id AS run_id, turn + 1 AS segment_id, turn * 1500 AS start_ms, turn * 1500 + 1234 AS end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations""")
def q_segments(t):
    """Transcripts written as JSON and read back; odd conversations leave the ids out."""
    s = F.struct(
        F.when(F.col("conv_id") % 2 == 0, F.col("turn") + 1).alias("segment_id"), (F.col("turn") * 1.5).alias("start_sec"),
        (F.col("turn") * 1.5 + 1.234).alias("end_sec"), F.col("text").alias("text"))
    from lectern import schemas

    docs = t.base("conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", s.alias("s")))), lambda r: r["s"]).alias("segments")).select(
        F.col("conv_id").alias("run_id"), F.to_json(F.struct("segments")).alias("json"))
    return readers.explode_segments(docs.select("run_id", F.from_json("json", schemas.SEGMENTS_JSON).alias("j")).select("run_id", "j.*"))


@query("read_slide_map", """
SELECT l_orderkey AS run_id, l_linenumber * 3 AS event_id, l_linenumber * 1500 AS slide_start_ms, l_linenumber * 1500 + l_partkey % 1000 AS slide_end_ms,
       l_suppkey % 4 = 0 AS is_no_slide, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS merge_target_event_id, COUNT(*) AS n
FROM lineitem WHERE l_partkey % 6 <> 0 GROUP BY ALL""")
def q_map(t):
    """Lenient event rows: bad event ids count as none."""
    from lectern import schemas

    e = F.struct(
        F.when(F.col("l_partkey") % 6 == 0, "x").otherwise((F.col("l_linenumber") * 3).cast("string")).alias("event_id"),
        (F.col("l_linenumber") * 1.5).alias("slide_start"), (F.col("l_linenumber") * 1.5 + (F.col("l_partkey") % 1000) / 1000.0).alias("slide_end"),
        F.when(F.col("l_suppkey") % 4 == 0, "True").otherwise("False").alias("is_no_slide"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey").cast("string")).otherwise("None").alias("merge_target_event_id"))
    docs = t.base("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.to_json(F.struct(F.collect_list(e).alias("events"))).alias("json"))
    payload = docs.select("run_id", F.from_json("json", schemas.SLIDE_MAP_JSON).alias("j")).select("run_id", "j.*")
    numbered = readers.number_slides(readers.parse_slide_map(payload), t.by_order)
    return numbered.groupBy("run_id", "event_id", "slide_start_ms", "slide_end_ms", "is_no_slide", "merge_target_event_id").agg(F.count(F.lit(1)).alias("n"))


@query("read_alignment", with_fixtures("""
SELECT video_id AS run_id, segment_id, source_start_ms, source_end_ms, tts_start_ms, tts_end_ms FROM alignment_fx""", "alignment_fx"))
def q_alignment(t):
    from lectern import schemas

    sec = [(F.col(f"{n}_ms") / 1000.0).alias(f"{n}_sec") for n in ("source_start", "source_end", "tts_start", "tts_end")]
    docs = t.alignment().groupBy(F.col("video_id").alias("run_id")).agg(
        F.to_json(F.struct(F.collect_list(F.struct("segment_id", *sec)).alias("segments"))).alias("json"))
    payload = docs.select("run_id", F.from_json("json", schemas.ALIGNMENT_JSON).alias("j")).select("run_id", "j.*")
    return readers.explode_alignment(payload)[0]


@query("read_alignment_words", with_fixtures("""
SELECT video_id AS run_id, word_idx, normalized AS text, normalized, start_ms, end_ms FROM words_fx""", "words_fx"))
def q_alignment_words(t):
    """Words of alignment files; every second one without its own normalized form."""
    from lectern import schemas

    w = F.struct(
        F.col("normalized").alias("text"), (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"),
        F.when(F.col("word_idx") % 2 == 0, F.col("normalized")).otherwise(" ").alias("normalized"))
    docs = t.words().groupBy(F.col("video_id").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("word_idx", w.alias("w")))).alias("ws"))
    payload = docs.select("run_id", F.to_json(F.struct(F.transform("ws", lambda x: x["w"]).alias("words"))).alias("json"))
    return readers.explode_alignment(payload.select("run_id", F.from_json("json", schemas.ALIGNMENT_JSON).alias("j")).select("run_id", "j.*"))[1]


@query("flat_rows", """
SELECT conv_id AS conv_id_n, CAST(conv_id AS VARCHAR) AS conv_id, string_agg(CAST(turn AS VARCHAR), ';' ORDER BY turn) AS turns, CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag FROM conversations GROUP BY 1""".replace("conv_id AS conv_id_n, ", "").replace("GROUP BY 1", "GROUP BY conv_id"))
def q_flat(t):
    rows = t.base("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return sinks.flatten(rows.withColumn("flag", F.col("conv_id") % 2 == 0))


@query("payloads", """
SELECT conv_id, '{"event_count":' || COUNT(*) || ',"events":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' AS payload FROM conversations GROUP BY 1""")
def q_payloads(t):
    return sinks.payloads(t.base("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
