"""Queries over texts, translation memory and termbase."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import casts, text
from lectern.operators import memory
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query

WORD = r"[^\p{L}\p{N}_]"


@query("text_keys", with_fixtures(r"""
SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS norm_tm,
       trim(regexp_replace(translate(line, '‘’‚‛“”„‟′″' || chr(160), repeat('''', 4) || repeat(chr(34), 4) || '''' || chr(34) || ' '), '\s+', ' ', 'g')) AS norm_slide,
       length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) AS alnum_chars,
       regexp_matches(line, '[\p{L}\p{N}]') AS translatable
FROM text_lines_fx""", "text_lines_fx"))
def q_keys(t):
    line = F.col("line")
    return t.text_lines().select(
        "doc_id", "line_no", text.norm_tm(line).alias("norm_tm"), text.norm_slide(line).alias("norm_slide"),
        F.length(text.alnum_only(line)).cast("bigint").alias("alnum_chars"), text.is_translatable(line).alias("translatable"))


@query("text_sizes", with_fixtures(r"""
SELECT doc_id, line_no, len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS tokens, strlen(line) AS utf8_bytes,
       CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS words,
       CASE WHEN length(c) <= 48 THEN c ELSE substr(c, 1, 47) || '…' END AS short,
       CASE WHEN right(trim(line), 1) IN ('.', '!', '?') THEN 60 WHEN right(trim(line), 1) IN (',', ';', ':') THEN 25 ELSE 0 END AS bonus_pct,
       CAST(round_even(GREATEST(200.0, LEAST(12000.0, GREATEST((CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END) * 1000 / 2.8, length(c) * 1000 / 16.0, 350.0))), 0) AS BIGINT) AS estimate_ms
FROM (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS c FROM text_lines_fx) t""", "text_lines_fx"))
def q_sizes(t):
    from lectern.functions.times import estimate_duration_ms

    line = F.col("line")
    return t.text_lines().select(
        "doc_id", "line_no", text.token_count(line).alias("tokens"), text.utf8_size(line).alias("utf8_bytes"),
        text.word_count(line).alias("words"), text.short_text(line).alias("short"),
        text.punctuation_bonus_pct(line).alias("bonus_pct"), estimate_duration_ms(text.collapse(line)).alias("estimate_ms"))


@query("token_folding", with_fixtures(r"""
SELECT doc_id, line_no, array_to_string(list_filter(list_transform(regexp_extract_all(line, '[\p{L}\p{N}_]+'), lambda w: strip_accents(lower(replace(w, '_', '')))), lambda w: w <> ''), ' ') AS tokens,
       trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS compared
FROM text_lines_fx""", "text_lines_fx"))
def q_tokens(t):
    line = F.col("line")
    return t.text_lines().select("doc_id", "line_no", F.array_join(text.tokens(line), " ").alias("tokens"),
                                 text.norm_compare(line).alias("compared"))


@query("list_markers", with_fixtures(r"""
SELECT doc_id, line_no, k, word, word IN ('•', '●', '◦', '▪', '■', '▸', '▹', '►', '‣', '∙', '·', '○', '◯', '◆', '◇', '*', '-', '–', '—') AS is_marker
FROM (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM text_lines_fx) t""", "text_lines_fx"))
def q_markers(t):
    words = t.text_lines().select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "word"))
    return words.select("doc_id", "line_no", (F.col("k") + 1).cast("bigint").alias("k"), "word",
                        text.is_list_marker(F.col("word")).alias("is_marker"))


@query("split_units", r"""
SELECT doc_id, len(p) AS parts, len(list_filter(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) = '')) AS separators,
       array_to_string(p, '') = text AS joins_back
FROM (SELECT doc_id, text, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])([ \t\r\f]\s*)', '\1' || chr(1) || '\2' || chr(1), 'g'),
             '(\n+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents) t""")
def q_split(t):
    parts = text.split_units(F.col("text"))
    return t.base("documents").select("doc_id", "text", parts.alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("parts"),
        F.size(F.filter("p", text.is_separator)).cast("bigint").alias("separators"),
        (F.array_join("p", "") == F.col("text")).alias("joins_back"))


@query("parse_ids", """
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ';') AS ids FROM lineitem GROUP BY 1""")
def q_ids(t):
    """Id lists written out with bad and repeated parts, and read back."""
    raw = F.concat_ws(",", F.collect_list(F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(";x"))))
    return t.base("lineitem").groupBy("l_orderkey").agg(raw.alias("raw")).select(
        "l_orderkey", F.array_join(text.parse_ids(F.col("raw")), ";").alias("ids"))


@query("lenient_casts", """
SELECT event_id, v, lower(trim(v)) IN ('1', 'true', 'yes', 'on') AS listed, lower(trim(v)) NOT IN ('', '0', 'false', 'no', 'off') AS not_off,
       lower(trim(v)) IN ('1', 'true', 'yes') AS strict, COALESCE(TRY_CAST(v AS BIGINT), 7) AS as_int
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN 'on' WHEN 2 THEN 'off' WHEN 3 THEN '' WHEN 4 THEN 'TRUE'
                                         WHEN 5 THEN CAST(event_id % 3 AS VARCHAR) ELSE event_type END AS v FROM events) t""")
def q_casts(t):
    m = F.col("event_id") % 7
    v = (F.when(m == 0, " Yes").when(m == 1, "on").when(m == 2, "off").when(m == 3, "").when(m == 4, "TRUE")
         .when(m == 5, (F.col("event_id") % 3).cast("string")).otherwise(F.col("event_type")))
    e = t.base("events").select("event_id", v.alias("v"))
    return e.select("event_id", "v", casts.bool_listed(F.col("v")).alias("listed"),
                    casts.bool_not_off(F.col("v"), False).alias("not_off"), casts.bool_strict(F.col("v")).alias("strict"),
                    casts.int_or(F.col("v"), 7).alias("as_int"))


@query("name_parts", r"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS event_no, user_id AS slide_no,
       strftime(ts, '%d-%b-%Y, %H:%M') AS label, CASE WHEN event_type = 'view' THEN 'translated' ELSE event_type || '-' || user_id END AS slug
FROM events""")
def q_names(t):
    name = F.concat(F.format_string("slide_%03d_", F.col("user_id")),
                    F.when(F.col("event_id") % 3 == 0, F.lit("xevent_")).otherwise(F.lit("event_")),
                    F.col("event_id").cast("string"), F.lit("_f000001"))
    label = F.when(F.col("event_type") == "view", F.lit("--")).otherwise(
        F.concat(F.initcap("event_type"), F.lit(" / "), F.col("user_id").cast("string"), F.lit(" !")))
    run = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    return t.base("events").select(
        "event_id", text.event_id_from_name(name).alias("event_no"), text.slide_index_from_name(name).alias("slide_no"),
        text.run_label(run).alias("label"), text.lang_slug(label).alias("slug"))


@query("clock_texts", """
SELECT l_orderkey, l_linenumber, l_partkey, ms, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS timecode,
       printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS srt
FROM (SELECT *, CAST(round_even(l_extendedprice * 1000, 0) AS BIGINT) AS ms FROM lineitem) t""")
def q_clock(t):
    from lectern.functions.times import srt_time, timecode, to_ms

    ms = to_ms(F.col("l_extendedprice"))
    return t.base("lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", ms.alias("ms"),
                                     timecode(ms).alias("timecode"), srt_time(ms).alias("srt"))


@query("speech_text", with_fixtures("""
SELECT s.video_id, s.segment_id, COALESCE(NULLIF(trim(l.translated_text), ''), NULLIF(trim(s.text), '')) AS tts_text
FROM segments_fx s LEFT JOIN translations_fx l ON l.video_id = s.video_id AND l.segment_id = CAST(s.segment_id AS VARCHAR) AND l.pos % 2 = 0
WHERE COALESCE(NULLIF(trim(l.translated_text), ''), NULLIF(trim(s.text), '')) IS NOT NULL""", "segments_fx", "translations_fx"))
def q_speech(t):
    tr = t.translations().where("pos % 2 = 0").select(
        "video_id", F.col("segment_id").try_cast("bigint").alias("segment_id"), "translated_text")
    out = t.segments().join(tr, ["video_id", "segment_id"], "left")
    return out.select("video_id", "segment_id", text.speech_text(F.col("translated_text"), F.col("text")).alias("tts_text")
                      ).where(F.col("tts_text").isNotNull())


# -- memory -----------------------------------------------------------------

NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
LAST_NEW = f"""
n AS (SELECT {NORM.format('source_text')} AS source_text_norm, target_language, arg_max(source_text, (run_id, pos)) AS source_text,
             trim(arg_max(target_text, (run_id, pos))) AS target_text, arg_max(run_id, (run_id, pos)) AS run_id
      FROM tm_new_fx WHERE {NORM.format('source_text')} <> '' GROUP BY 1, 2)"""


@query("tm_merge", with_fixtures(LAST_NEW + """
SELECT COALESCE(n.source_text_norm, o.source_text_norm) AS source_text_norm, COALESCE(n.target_language, o.target_language) AS target_language,
       COALESCE(n.source_text, o.source_text) AS source_text, COALESCE(n.target_text, o.target_text) AS target_text,
       'machine_unreviewed' AS status, COALESCE(n.run_id, o.origin_run_id) AS origin_run_id, COALESCE(hit_count, 0) AS hit_count,
       COALESCE(created_at, 777) AS created_at, CASE WHEN n.source_text IS NOT NULL THEN 777 ELSE updated_at END AS updated_at
FROM tm_entries_fx o FULL JOIN n ON n.source_text_norm = o.source_text_norm AND n.target_language = o.target_language""",
    "tm_new_fx", "tm_entries_fx"))
def q_merge(t):
    return memory.tm_merge(t.tm_entries(), t.tm_new(), F.lit(777).cast("bigint"))


@query("tm_bootstrap", with_fixtures(LAST_NEW + """
SELECT source_text_norm, target_language, source_text, target_text, 'bootstrap' AS status, run_id AS origin_run_id, 0 AS hit_count,
       5 AS created_at, 5 AS updated_at FROM n""", "tm_new_fx"))
def q_bootstrap(t):
    return memory.tm_bootstrap(t.tm_new(), F.lit(5).cast("bigint"))


LOOKED = f"""
looked AS (SELECT l.doc_id, l.line_no, l.lang, {NORM.format('l.line')} AS norm, o.target_text, o.target_text IS NOT NULL AS hit
           FROM text_lines_fx l LEFT JOIN tm_entries_fx o ON o.source_text_norm = {NORM.format('l.line')} AND o.target_language = l.lang)"""


@query("tm_lookup", with_fixtures(LOOKED + """
SELECT doc_id, line_no, target_text AS tm_target_text, hit AS tm_exact_hit FROM looked""", "text_lines_fx", "tm_entries_fx"))
def q_lookup(t):
    return memory.tm_lookup(t.text_lines(), t.tm_entries(), "line", "lang").select(
        "doc_id", "line_no", "tm_target_text", "tm_exact_hit")


@query("tm_hit_counts", with_fixtures(LOOKED + """
SELECT o.source_text_norm, o.target_language, o.hit_count + COUNT(l.doc_id) AS hit_count,
       CASE WHEN COUNT(l.doc_id) > 0 THEN 9 ELSE o.updated_at END AS updated_at
FROM tm_entries_fx o LEFT JOIN looked l ON l.norm = o.source_text_norm AND l.lang = o.target_language
GROUP BY o.source_text_norm, o.target_language, o.hit_count, o.updated_at""", "text_lines_fx", "tm_entries_fx"))
def q_hits(t):
    looked = memory.tm_lookup(t.text_lines(), t.tm_entries(), "line", "lang").withColumnRenamed("lang", "target_language")
    out = memory.tm_add_hits(t.tm_entries(), looked, F.lit(9).cast("bigint"))
    return out.select("source_text_norm", "target_language", "hit_count", "updated_at")


@query("tm_hits_within_batch", with_fixtures(f"""
c AS (SELECT doc_id, line_no, {NORM.format('line')} AS norm, (line_no - 1) // 4 + 1 AS chunk_index FROM text_lines_fx)
SELECT doc_id, line_no, chunk_index > MIN(chunk_index) OVER (PARTITION BY doc_id, norm) AS repeat_hit FROM c""", "text_lines_fx"))
def q_repeat(t):
    rows = t.text_lines().select("doc_id", "line_no", text.norm_tm(F.col("line")).alias("norm"),
                                 (F.floor((F.col("line_no") - 1) / 4) + 1).alias("chunk_index"))
    return memory.repeat_hits(rows, ["doc_id", "norm"]).select("doc_id", "line_no", "repeat_hit")


PACK = """
seg AS (SELECT video_id, segment_id, length(text) AS n, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, segment_id) AS rn
        FROM segments_fx WHERE trim(text) <> ''),
fold AS (SELECT video_id, segment_id, rn, 1 AS chunk_index, 1 AS cnt, n AS chars FROM seg WHERE rn = 1
         UNION ALL
         SELECT s.video_id, s.segment_id, s.rn, CASE WHEN o.full_up THEN f.chunk_index + 1 ELSE f.chunk_index END,
                CASE WHEN o.full_up THEN 1 ELSE f.cnt + 1 END, CASE WHEN o.full_up THEN s.n ELSE f.chars + s.n END
         FROM fold f JOIN seg s ON s.video_id = f.video_id AND s.rn = f.rn + 1,
         LATERAL (SELECT f.cnt >= 3 OR f.chars + s.n > 700 AS full_up) o)"""


@query("pack_chunks", with_fixtures(PACK + " SELECT video_id, segment_id, chunk_index FROM fold", "segments_fx", recursive=True))
def q_pack(t):
    return memory.pack_chunks(t.segments(), 3, 700)


@query("pack_speech_chunks", with_fixtures("""
seg AS (SELECT video_id, segment_id, length(trim(text)) AS n, strlen(trim(text)) AS b, start_ms, end_ms,
               ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, segment_id) AS rn
        FROM segments_fx WHERE trim(text) <> ''),
whole AS (SELECT video_id, SUM(b) + COUNT(*) - 1 <= 900 AND MAX(end_ms) - MIN(start_ms) <= 20000 AS single FROM seg GROUP BY 1),
fold AS (SELECT video_id, segment_id, rn, b AS own, 1 AS chunk_index, 1 AS cnt, n AS chars, b AS bytes FROM seg WHERE rn = 1
         UNION ALL
         SELECT s.video_id, s.segment_id, s.rn, s.b, CASE WHEN o.full_up THEN f.chunk_index + 1 ELSE f.chunk_index END,
                CASE WHEN o.full_up THEN 1 ELSE f.cnt + 1 END, CASE WHEN o.full_up THEN s.n ELSE f.chars + 1 + s.n END,
                CASE WHEN o.full_up THEN s.b ELSE f.bytes + 1 + s.b END
         FROM fold f JOIN seg s ON s.video_id = f.video_id AND s.rn = f.rn + 1,
         LATERAL (SELECT f.cnt >= 4 OR f.chars + 1 + s.n > 800 OR f.bytes + 1 + s.b > 900 AS full_up) o)
SELECT f.video_id, segment_id, CASE WHEN single THEN 1 ELSE chunk_index END AS chunk_index,
       CASE WHEN single THEN 'single_request' ELSE 'chapter_chunks' END AS mode, NOT single AND own > 900 AS oversize
FROM fold f JOIN whole w ON w.video_id = f.video_id""", "segments_fx", recursive=True))
def q_pack_speech(t):
    return memory.pack_speech_chunks(
        t.segments().withColumn("translated_text", F.lit("")), 500, max_chars=800, max_segments=4, max_text=900,
        single_max_ms=20000)


@query("number_batches", with_fixtures(f"""
d AS (SELECT DISTINCT source AS run_id, {NORM.format('line')} AS norm FROM text_lines_fx)
SELECT run_id, norm, (ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY norm) - 1) // 32 + 1 AS batch_no FROM d""", "text_lines_fx"))
def q_batches(t):
    rows = t.text_lines().select(F.col("source").alias("run_id"), text.norm_tm(F.col("line")).alias("norm")).distinct()
    return memory.number_batches(rows, ["run_id"], ["norm"], 32)


def _termbase(t):
    """All lines as terms of a file, with unusable rows among them."""
    d = F.col("doc_id")
    lang = F.element_at(F.array(*[F.lit(v) for v in ("de", "*", "", "fr")]), (F.col("line_no") % 4 + 1).cast("int"))
    return t.text_lines().select(
        (d * 100000 + F.col("line_no")).alias("pos"), F.col("line").alias("source_text"), lang.alias("target_language"),
        F.when(F.col("line_no") % 9 == 0, "").otherwise(F.concat(F.lit("TB:"), F.col("line"))).alias("target_text"),
        F.when(F.col("line_no") % 2 == 0, "yes").otherwise("0").alias("case_sensitive"))


TERMS = """
tb AS (SELECT doc_id * 100000 + line_no AS pos, trim(line) AS source_text, ['de', '*', '', 'fr'][line_no % 4 + 1] AS lang,
              CASE WHEN line_no % 9 = 0 THEN '' ELSE trim('TB:' || line) END AS target_text, line_no % 2 = 0 AS case_sensitive
       FROM text_lines_fx),
terms AS (SELECT pos, source_text, CASE WHEN lang = '' THEN 'de' ELSE lang END AS target_language, target_text, case_sensitive, -length(source_text) AS neg_length
          FROM tb WHERE source_text <> '' AND target_text <> '' AND lang IN ('de', '*', ''))"""


@query("read_termbase", with_fixtures(TERMS + " SELECT * FROM terms", "text_lines_fx"))
def q_termbase(t):
    out = memory.select_termbase(_termbase(t), "de")
    return out.select("pos", "source_text", "target_language", "target_text", "case_sensitive",
                      F.col("term_order.neg_length").cast("bigint").alias("neg_length"))


EXACT = f"""
exact AS (SELECT {NORM.format('source_text')} AS norm, arg_min(target_text, (neg_length, pos)) AS target_text FROM terms GROUP BY 1),
cnd AS (SELECT DISTINCT {NORM.format('line')} AS norm FROM text_lines_fx)"""


def _match(t):
    cand = t.text_lines().select(text.norm_slide(F.col("line")).alias("source_text_norm")).distinct()
    return memory.match_termbase(cand, memory.select_termbase(_termbase(t), "de"))


@query("termbase_exact", with_fixtures(TERMS + "," + EXACT + """
SELECT c.norm AS source_text_norm, target_text, 'termbase' AS origin, 'frozen' AS status FROM cnd c JOIN exact e ON e.norm = c.norm""", "text_lines_fx"))
def q_exact(t):
    return _match(t)[0]


@query("termbase_pending", with_fixtures(TERMS + "," + EXACT + """
SELECT norm AS source_text_norm FROM cnd WHERE norm NOT IN (SELECT norm FROM exact)""", "text_lines_fx"))
def q_pending(t):
    return _match(t)[1]


@query("read_glossary", with_fixtures(f"""
SELECT {NORM.format('source_text')} AS source_text_norm, arg_min(target_text, (run_id, pos)) AS target_text FROM tm_new_fx
WHERE {NORM.format('source_text')} <> '' GROUP BY 1""", "tm_new_fx"))
def q_glossary(t):
    from lectern.operators.glossary import first_glossary

    rows = t.tm_new().withColumn("entry_order", F.struct("run_id", "pos")).withColumnRenamed("source_text", "source_text_norm")
    return first_glossary(rows, "entry_order").select("source_text_norm", "target_text")


# Fixed terms of the protection query.
PROTECT_TERMS = [
    (1, "the", "*", "der", "0"), (2, "of the", "", "des", "no"), (3, "and", "*", "und", "0"), (4, "La", "de", "Die", "1"),
    (5, "que", "zz", "was", "0"), (6, "un", "*", "", "0"), (7, "er.", "*", "ER.", "0"),
]


def _protect(t):
    terms = t.spark.createDataFrame(
        PROTECT_TERMS, "pos bigint, source_text string, target_language string, target_text string, case_sensitive string")
    return memory.protect_terms(t.text_lines(), "line", memory.select_termbase(terms, "de"))


def _count(expr: str, term: str) -> str:
    return f"len(regexp_extract_all({expr}, '(^|{WORD}){term}($|{WORD})'))"


@query("protect_terms", with_fixtures(f"""
SELECT doc_id, line_no, {_count('a', 'of  the')} + {_count("b", 'the')} + {_count("b", 'and')} + {_count("dbl", 'La')}
       + len(regexp_extract_all(a, '(^|{WORD})er[.]')) AS termbase_hits
FROM (SELECT *, regexp_replace(a, '(^|{WORD})of  the($|{WORD})', '\\1@\\2', 'g') AS b
      FROM (SELECT doc_id, line_no, regexp_replace(line, '({WORD})', '\\1\\1', 'g') AS dbl,
                   lower(regexp_replace(line, '({WORD})', '\\1\\1', 'g')) AS a FROM text_lines_fx) q) t""", "text_lines_fx"))
def q_protect(t):
    return _protect(t).select("doc_id", "line_no", "termbase_hits")


def _swapped(expr: str, term: str, target: str, right: bool = True) -> str:
    """A whole word for its target in a text whose other signs are all doubled, so that neighbours share none."""
    behind, kept = (f"($|{WORD})", "\\2") if right else ("", "")
    return f"regexp_replace({expr}, '{term[0]}(^|{WORD}){term[1]}{behind}', '\\1{target}{kept}', 'g')"


RESTORED = _swapped(_swapped(_swapped(_swapped(_swapped(
    f"regexp_replace(line, '({WORD})', '\\1\\1', 'g')", ("(?i)", "of  the"), "des"), ("(?i)", "the"), "der"), ("(?i)", "and"), "und"),
    ("(?i)", "er[.][.]"), "ER..", False), ("", "La"), "Die")


@query("restore_terms", with_fixtures(f"""
SELECT doc_id, line_no, regexp_replace({RESTORED}, '({WORD}){WORD}', '\\1', 'g') AS restored, FALSE AS lost FROM text_lines_fx""", "text_lines_fx"))
def q_restore(t):
    """Protected texts come back complete, with the targets in place of the terms."""
    restored, lost = memory.restore_terms(F.col("protected.text"), F.col("protected.keys"), F.col("protected.targets"))
    return _protect(t).select("doc_id", "line_no", restored.alias("restored"), lost.alias("lost"))


TERM_TEXT, TERM_TARGET = "the", "DER"


def spoken_twice(t):
    """Segments in two spellings, every fifth with double blanks."""
    s = t.segments().withColumn("text", text.collapse(F.col("text")))
    return s.withColumn("text", F.when(F.col("segment_id") % 5 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text")))


def given_terms(t):
    return t.spark.createDataFrame(
        [(1, TERM_TEXT, "*", TERM_TARGET, "0")], "pos bigint, source_text string, target_language string, target_text string, case_sensitive string")


def given_memory(s):
    return s.where("segment_id % 4 = 0").groupBy(text.norm_tm(F.col("text")).alias("source_text_norm")).agg(
        F.lit("German").alias("target_language"), F.concat(F.lit("tm "), F.min("text")).alias("target_text"))


def given_model(t, s):
    """What a model gave for protected texts: nothing for double blanks and for every seventh segment."""
    known = s.where("segment_id % 7 <> 6 AND segment_id % 5 <> 0").select("text").distinct()
    protected = memory.protect_terms(known, "text", memory.select_termbase(given_terms(t), "German")).select("protected.text").distinct()
    return protected.select(
        F.col("text").alias("protected_text"), F.lit("German").alias("target_language"), F.concat(F.lit("new "), "text").alias("translated_text"))


def _translated(t):
    s = spoken_twice(t)
    terms = memory.select_termbase(given_terms(t), "German")
    return memory.translate_with_memory(s, given_memory(s), terms, given_model(t, s), "German", 3, 700)


def translated_sql(count: int, chars: int) -> str:
    edge = r"[^\p{L}\p{N}_]"
    whole = f"'(?i)(^|{edge}){TERM_TEXT}({edge}|$)'"
    new = f"'new ' || array_to_string(list_transform(string_split(text, ' '), lambda w: regexp_replace(w, {whole}, '\\1{TERM_TARGET}\\2', 'g')), ' ')"
    pack = PACK.replace("f.cnt >= 3", f"f.cnt >= {count}").replace("> 700", f"> {chars}")
    return pack.replace("FROM segments_fx WHERE", "FROM cs WHERE", 1).replace("\nseg AS", f"""
cs AS (SELECT video_id, segment_id, start_ms, end_ms, norm, CASE WHEN segment_id % 5 = 0 THEN replace(norm, ' ', '  ') ELSE norm END AS text
       FROM (SELECT *, {NORM.format('text')} AS norm FROM segments_fx) q),
tm AS (SELECT norm, 'tm ' || MIN(text) AS tgt FROM cs WHERE segment_id % 4 = 0 GROUP BY 1),
model AS (SELECT DISTINCT text, {new} AS tgt, len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, {whole}))) AS hits
          FROM cs WHERE segment_id % 7 <> 6 AND segment_id % 5 <> 0),
seg AS""", 1) + """,
st AS (SELECT s.*, f.chunk_index, tm.tgt AS tm_text, m.tgt AS model_text, m.hits FROM cs s LEFT JOIN fold f ON f.video_id = s.video_id AND f.segment_id = s.segment_id
       LEFT JOIN tm ON tm.norm = s.norm LEFT JOIN model m ON m.text = s.text),
wr AS (SELECT video_id, norm, chunk_index AS first_chunk, arg_max(model_text, (start_ms, end_ms, segment_id)) AS earlier FROM st WHERE tm_text IS NULL AND model_text IS NOT NULL AND chunk_index IS NOT NULL
       GROUP BY 1, 2, 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY video_id, norm ORDER BY chunk_index) = 1),
fs AS (SELECT s.*, tm_text IS NULL AND COALESCE(s.chunk_index > first_chunk, FALSE) AS later, earlier FROM st s LEFT JOIN wr ON wr.video_id = s.video_id AND wr.norm = s.norm)
SELECT video_id, segment_id, COALESCE(tm_text, CASE WHEN later THEN earlier ELSE model_text END, text) AS translated_text,
       CASE WHEN trim(text) = '' THEN 'skipped_empty' WHEN tm_text IS NOT NULL OR later THEN 'tm_exact' WHEN model_text IS NULL THEN 'source_fallback'
            WHEN hits > 0 THEN 'translated_with_termbase' ELSE 'translated' END AS translation_status,
       CASE WHEN tm_text IS NOT NULL OR later OR model_text IS NULL THEN 0 ELSE COALESCE(hits, 0) END AS termbase_hits
FROM fs"""


@query("translated_segments", with_fixtures(translated_sql(3, 700), "segments_fx", recursive=True))
def q_translated(t):
    return _translated(t).select("video_id", "segment_id", "translated_text", "translation_status", "termbase_hits")


@query("event_status", with_fixtures("""
SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'skipped_empty' WHEN doc_id % 7 = 3 THEN 'error' WHEN hits > 0 AND n = hits THEN 'tm_exact' WHEN hits > 0 THEN 'translated_with_tm' WHEN terms > 0 THEN 'translated_with_termbase' ELSE 'translated' END AS status
FROM (SELECT doc_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE line_no % 3 = 1) AS hits, SUM(line_no % 2) AS terms FROM text_lines_fx GROUP BY 1) t""", "text_lines_fx"))
def q_event_status(t):
    g = t.text_lines().groupBy("doc_id").agg(
        F.count_if(F.col("line_no") % 3 == 1).alias("hits"), F.count_if(F.col("line_no") % 3 != 1).alias("new"),
        F.sum(F.col("line_no") % 2).alias("terms"))
    text_, failed = F.when(F.col("doc_id") % 11 == 5, " ").otherwise("x"), F.col("doc_id") % 7 == 3
    return g.select("doc_id", memory.event_status(text_, failed, F.col("hits"), F.col("new"), F.col("terms")).alias("status"))


@query("glossary_lines", with_fixtures("""
SELECT doc_id, string_agg('- ' || line || ' -> T:' || line, chr(10) ORDER BY line_no) AS glossary FROM text_lines_fx GROUP BY 1""", "text_lines_fx"))
def q_lines(t):
    pairs = t.text_lines().select("doc_id", "line_no", F.col("line").alias("source_text"),
                                  F.concat(F.lit("T:"), F.col("line")).alias("target_text"))
    return memory.glossary_lines(pairs, ["doc_id"], "line_no")
