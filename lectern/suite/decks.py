"""Queries over the text units of slides and deck glossaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lectern.functions.boxes import Box, box_union, expand, inflate
from lectern.functions.measures import nearest_percentiles
from lectern.functions.scores import font_default, graphic_score, hex_rgb, is_graphic, is_noise, padding_shorthand
from lectern.functions.text import alnum_only
from lectern.operators import glossary, ocr, roles
from lectern.operators.grouped import with_group_values
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query


def doubles(sql: str) -> str:
    """Decimal literals as doubles, so that the oracle adds like the engine does."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def _units(t):
    return t.ocr_units().withColumns({
        "event_id": F.col("slide_index"), "graphic_score": F.col("graphic_score_tenths") / 10.0})


def _hot(t):
    return t.split("documents", "doc_id")


MEASURED = doubles(r"""
mu AS (SELECT slide_id, deck_id, unit_id, slide_index, slide_index AS event_id, source_text, x, y, GREATEST(1, w) AS w, GREATEST(1, h) AS h, GREATEST(1, line_count) AS line_count,
              list_marker, graphic_score_tenths / 10.0 AS graphic_score, image_w, image_h, len(string_split(trim(regexp_replace(source_text, '\s+', ' ', 'g')), ' ')) AS words,
              x / 1280 AS rel_left, y / 720 AS rel_top, (y + GREATEST(1, h)) / 720 AS rel_bottom, GREATEST(1, w) / 1280 AS rel_width,
              (x + GREATEST(1, w) / 2.0) / 1280 AS center_x, (y + GREATEST(1, h) / 2.0) / 720 AS center_y
       FROM ocr_units_fx)""")
HEIGHTS = """
hs AS (SELECT slide_id, median(h) AS median_h, list_sort(list(h)) AS l FROM mu WHERE NOT list_marker GROUP BY 1),
ht AS (SELECT slide_id, median_h, l[CAST(round_even((len(l) - 1) * CAST(0.75 AS DOUBLE), 0) AS BIGINT) + 1] AS p75_h,
              l[CAST(round_even((len(l) - 1) * CAST(0.9 AS DOUBLE), 0) AS BIGINT) + 1] AS p90_h FROM hs)"""
BASE_ROLES = doubles("""
hu AS (SELECT m.*, COALESCE(median_h, 24.0) AS median_h, COALESCE(CAST(p75_h AS DOUBLE), median_h, 24.0) AS p75_h,
              COALESCE(CAST(p90_h AS DOUBLE), CAST(p75_h AS DOUBLE), median_h, 24.0) AS p90_h
       FROM mu m LEFT JOIN ht ON ht.slide_id = m.slide_id),
ti AS (SELECT slide_id, unit_id AS t_id, y AS t_y, h AS t_h FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY slide_id ORDER BY h * 2.0 + w * 0.08 - y * 0.04 - GREATEST(0, words - 8) * 1.2 + CASE WHEN h >= p90_h THEN 10.0 ELSE 0.0 END DESC, unit_id) AS k
         FROM hu WHERE NOT list_marker AND rel_top <= 0.34 AND words <= 18 AND h >= GREATEST(median_h * 1.2, p75_h * 0.95)) q WHERE k = 1),
su AS (SELECT slide_id, unit_id AS s_id FROM (
         SELECT h.*, ROW_NUMBER() OVER (PARTITION BY h.slide_id ORDER BY h * 1.6 + w * 0.05 - (y - (t_y + t_h)) * 0.06 - GREATEST(0, words - 12) * 0.9 DESC, unit_id) AS k
         FROM hu h JOIN ti ON ti.slide_id = h.slide_id
         WHERE unit_id <> t_id AND NOT list_marker AND y > t_y AND rel_top <= 0.5 AND y - (t_y + t_h) <= GREATEST(120, round_even(GREATEST(t_h, h) * 4.5, 0))
           AND words <= 26 AND h >= GREATEST(median_h * 1.02, p75_h * 0.75)) q WHERE k = 1),
sc AS (SELECT h.*, t_id, s_id,
         CASE WHEN words <= 8 THEN 0.9 WHEN words <= 14 THEN 0.6 WHEN words <= 20 THEN 0.2 WHEN words <= 28 THEN -0.4 ELSE -1.0 END
         + CASE WHEN line_count <= 1 THEN 0.7 WHEN line_count <= 2 THEN 0.5 WHEN line_count <= 3 THEN 0.1 ELSE -0.8 END
         + CASE WHEN h / GREATEST(1.0, median_h) >= 1.25 OR h / GREATEST(1.0, p75_h) >= 1.05 THEN 1.3 WHEN h / GREATEST(1.0, median_h) >= 1.12 OR h / GREATEST(1.0, p75_h) >= 0.95 THEN 0.9
                WHEN h / GREATEST(1.0, median_h) >= 1.0 THEN 0.45 WHEN h / GREATEST(1.0, median_h) >= 0.9 THEN 0.05 ELSE -0.7 END
         + CASE WHEN rel_top < 0.24 THEN 0.8 WHEN rel_top < 0.45 THEN 0.55 WHEN rel_top < 0.62 THEN 0.25 WHEN rel_top < 0.78 THEN -0.15 ELSE -0.7 END
         + CASE WHEN rel_width <= 0.78 THEN 0.25 WHEN rel_width <= 0.92 THEN 0.1 ELSE -0.15 END AS section_score
       FROM hu h LEFT JOIN ti ON ti.slide_id = h.slide_id LEFT JOIN su ON su.slide_id = h.slide_id),
r2 AS (SELECT *, CASE WHEN graphic_score >= 2.95 AND words > 0 AND words <= 10 AND line_count <= 3 AND rel_width <= 0.68 AND rel_top >= 0.12 THEN 'graphic_embedded'
                      WHEN list_marker THEN 'list_item_level_1' WHEN unit_id = t_id THEN 'title' WHEN unit_id = s_id THEN 'subtitle'
                      WHEN rel_bottom >= 0.96 AND h <= GREATEST(p75_h * 1.1, median_h * 1.25) THEN 'footer' WHEN section_score >= 2.0 THEN 'section_heading'
                      WHEN rel_top >= 0.66 AND rel_width <= 0.48 AND h <= GREATEST(p75_h * 1.1, median_h * 1.2) THEN 'caption' ELSE 'body' END AS role FROM sc)""")
PROMOTED = doubles("""
hd AS (SELECT slide_id, median(h) AS hh, MIN(rel_top) AS t0, MAX(rel_top) AS t1, median(rel_width) AS hw, median(words) AS hwords, median(line_count) AS hlines
       FROM r2 WHERE role = 'section_heading' GROUP BY 1),
r3 AS (SELECT r.* EXCLUDE (role), CASE WHEN role = 'body' AND hh IS NOT NULL AND section_score >= 1.5 AND h / GREATEST(1.0, hh) BETWEEN 0.82 AND 1.55
              AND rel_top >= GREATEST(0.0, t0 - 0.12) AND rel_top <= LEAST(0.9, t1 + 0.30)
              AND line_count <= GREATEST(3, round_even(hlines + 1, 0)) AND words <= GREATEST(24, round_even(hwords + 8, 0))
              AND rel_width / GREATEST(0.05, hw) BETWEEN 0.55 AND 1.65 THEN 'section_heading' ELSE role END AS role
       FROM r2 r LEFT JOIN hd ON hd.slide_id = r.slide_id)""")
NEIGHBOURS = doubles("""
nb AS (SELECT u.slide_id, u.unit_id, arg_min(a.unit_id, (a.y, a.x, a.unit_id)) AS anchor_unit_id
       FROM r3 u JOIN r3 a ON a.slide_id = u.slide_id AND a.role = 'graphic_embedded'
       WHERE u.role IN ('body', 'section_heading', 'caption') AND u.words BETWEEN 1 AND 7 AND u.rel_width <= 0.26 AND u.rel_top >= 0.18
         AND abs(u.x + u.w / 2.0 - (a.x + a.w / 2.0)) <= GREATEST(36.0, GREATEST(u.w, a.w) * 0.45)
         AND GREATEST(0, a.y - (u.y + u.h), u.y - (a.y + a.h)) <= GREATEST(42, round_even(GREATEST(u.h, a.h) * 0.6, 0))
       GROUP BY 1, 2),
r4 AS (SELECT r.* EXCLUDE (role), CASE WHEN anchor_unit_id IS NOT NULL THEN 'graphic_embedded' ELSE role END AS role
       FROM r3 r LEFT JOIN nb ON nb.slide_id = r.slide_id AND nb.unit_id = r.unit_id)""")
ZONED = doubles("""
za AS (SELECT slide_id, unit_id AS a_id FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY slide_id ORDER BY -(CASE WHEN role = 'section_heading' THEN 1.2 ELSE 0.0 END + section_score * 1.15 + (1.0 - rel_top) * 0.9 + (1.0 - rel_left) * 0.6
                                      + LEAST(1.0, h / 140.0) * 0.3), y, x, -w, unit_id) AS k
         FROM r4 WHERE role NOT IN ('title', 'subtitle', 'footer', 'graphic_embedded', 'list_item_level_1') AND NOT list_marker AND words BETWEEN 1 AND 14 AND line_count <= 2
           AND rel_top <= 0.36 AND rel_left <= 0.56 AND center_x <= 0.48 AND rel_width BETWEEN 0.08 AND 0.72) q WHERE k = 1),
r6 AS (SELECT r.* EXCLUDE (role), CASE WHEN unit_id = a_id THEN 'section_heading' WHEN role = 'section_heading' THEN 'body' ELSE role END AS role
       FROM r4 r LEFT JOIN za ON za.slide_id = r.slide_id)""")
HERO = doubles("""
h1 AS (SELECT slide_id, unit_id AS ht_id, x AS ht_x, y AS ht_y, w AS ht_w, h AS ht_h FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY slide_id ORDER BY -(CASE WHEN role = 'title' THEN 1.2 ELSE 0.0 END + GREATEST(0.0, section_score * 0.35) + LEAST(1.0, w / GREATEST(1.0, image_w * 0.52)) * 2.0
                                      + LEAST(1.0, h / 92.0) * 0.8 + (1.0 - rel_left) * 0.7 + (1.0 - abs(rel_top - 0.42)) * 0.5), y, x, -w, unit_id) AS k
         FROM r6 WHERE event_id = 1 AND role NOT IN ('graphic_embedded', 'footer', 'list_item_level_1') AND NOT list_marker AND words BETWEEN 1 AND 10 AND line_count <= 2
           AND rel_top BETWEEN 0.24 AND 0.62 AND rel_left <= 0.26 AND rel_width BETWEEN 0.20 AND 0.78 AND h >= GREATEST(24, round_even(image_h * 0.028, 0))) q WHERE k = 1),
h2 AS (SELECT slide_id, unit_id AS hs_id FROM (
         SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.slide_id ORDER BY abs(y - (ht_y + ht_h) - 54), abs(x - ht_x), -w, unit_id) AS k
         FROM r6 r JOIN h1 ON h1.slide_id = r.slide_id
         WHERE unit_id <> ht_id AND role NOT IN ('graphic_embedded', 'title', 'footer', 'list_item_level_1') AND NOT list_marker AND words BETWEEN 1 AND 10 AND line_count <= 2
           AND rel_left <= 0.32 AND rel_width BETWEEN 0.10 AND 0.55 AND y > ht_y + ht_h AND y - (ht_y + ht_h) <= GREATEST(230, round_even(ht_h * 3.8, 0))
           AND abs(x - ht_x) <= GREATEST(140, round_even(ht_w * 0.28, 0))) q WHERE k = 1),
r7 AS (SELECT r.* EXCLUDE (role), CASE WHEN ht_id IS NOT NULL AND unit_id = ht_id THEN 'title' WHEN ht_id IS NOT NULL AND unit_id = hs_id THEN 'subtitle'
                      WHEN ht_id IS NOT NULL AND role IN ('title', 'subtitle') THEN 'body' WHEN event_id <> 1 AND role = 'title' THEN 'section_heading' ELSE role END AS role
       FROM r6 r LEFT JOIN h1 ON h1.slide_id = r.slide_id LEFT JOIN h2 ON h2.slide_id = r.slide_id),
zones AS (SELECT *, CASE WHEN center_y < 0.18 THEN 'top' WHEN center_y < 0.38 THEN 'upper' WHEN center_y < 0.68 THEN 'middle' WHEN center_y < 0.88 THEN 'lower' ELSE 'bottom' END AS vz,
                 CASE WHEN center_x < 0.34 THEN 'left' WHEN center_x > 0.66 THEN 'right' ELSE 'center' END AS hz FROM r7),
slots AS (SELECT *, CASE WHEN starts_with(role, 'list_item_') THEN role || '.' || hz ELSE role || '.' || vz || '_' || hz END AS slot_id FROM zones)""")

TO_R2 = ",".join([MEASURED, HEIGHTS, BASE_ROLES])
TO_R4 = ",".join([TO_R2, PROMOTED, NEIGHBOURS])
TO_R7 = ",".join([TO_R4, ZONED, HERO])


@query("height_statistics", with_fixtures(MEASURED + "," + HEIGHTS + " SELECT * FROM ht", "ocr_units_fx"))
def q_heights(t):
    return roles.height_statistics(_units(t))


@query("base_roles", with_fixtures(TO_R2 + " SELECT slide_id, unit_id, words, round(section_score, 6) AS section_score, role FROM r2", "ocr_units_fx"))
def q_base(t):
    return roles.base_roles(_units(t), _hot(t)).select(
        "slide_id", "unit_id", "words", F.round("section_score", 6).alias("section_score"), "role")


@query("pick_title_subtitle", with_fixtures(TO_R2 + """
SELECT ti.slide_id, t_id AS title_unit_id, s_id AS subtitle_unit_id FROM ti LEFT JOIN su ON su.slide_id = ti.slide_id""", "ocr_units_fx"))
def q_title(t):
    df = roles.pick_subtitle(roles.pick_title(roles._with_heights(roles.measure_units(_units(t)), _hot(t)), _hot(t)), _hot(t))
    return df.where("__title IS NOT NULL").select(
        "slide_id", F.col("__title.unit_id").alias("title_unit_id"), F.col("__subtitle").alias("subtitle_unit_id")).distinct()


def _promoted(t):
    return roles.promote_headings(roles.base_roles(_units(t), _hot(t)), _hot(t))


@query("promote_headings", with_fixtures(TO_R2 + "," + PROMOTED + " SELECT slide_id, unit_id, role FROM r3", "ocr_units_fx"))
def q_promote(t):
    return _promoted(t).select("slide_id", "unit_id", "role")


@query("graphic_neighbours", with_fixtures(TO_R4 + " SELECT * FROM nb", "ocr_units_fx"))
def q_neighbours(t):
    return roles.graphic_neighbours(_promoted(t))


def _zoned(t):
    return roles.enforce_heading_zone(roles.promote_graphic_neighbours(_promoted(t), _hot(t)), _hot(t))


@query("heading_zone", with_fixtures(TO_R4 + "," + ZONED + " SELECT slide_id, unit_id, role FROM r6", "ocr_units_fx"))
def q_zone(t):
    return _zoned(t).select("slide_id", "unit_id", "role")


def _slotted(t):
    """Roles and slots without the list clusters, which have no SQL form."""
    return roles.add_slots(roles.enforce_hero(_zoned(t), _hot(t)))


@query("hero_title", with_fixtures(TO_R7 + " SELECT slide_id, unit_id, role FROM r7 WHERE role IN ('title', 'subtitle')", "ocr_units_fx"))
def q_hero(t):
    return _slotted(t).where("role IN ('title', 'subtitle')").select("slide_id", "unit_id", "role")


@query("slot_ids", with_fixtures(TO_R7 + " SELECT slide_id, unit_id, role, slot_id, vz AS slot_vertical_zone, hz AS slot_horizontal_zone FROM slots", "ocr_units_fx"))
def q_slots(t):
    return _slotted(t).select("slide_id", "unit_id", "role", "slot_id", "slot_vertical_zone", "slot_horizontal_zone")


@query("implicit_lists")
def q_implicit(t):
    """Greedy clusters; checked against a plain loop in the tests."""
    out = roles.implicit_lists(roles.promote_graphic_neighbours(_promoted(t), _hot(t)), _hot(t))
    return out.where("cluster_no IS NOT NULL").select("slide_id", "unit_id", "cluster_no", "cluster_size", "is_list")


@query("classify_units")
def q_classify(t):
    """All role stages including the greedy list clusters."""
    return roles.classify_units(_units(t), _hot(t)).select("slide_id", "unit_id", "role", "slot_id", "reason")


@query("stacked_groups")
def q_stacks(t):
    return glossary.stacked_groups(_units(t), _hot(t))


@query("box_union", with_fixtures("""
SELECT slide_id, MIN(x) AS x, MIN(y) AS y, GREATEST(1, MAX(x + GREATEST(1, w)) - MIN(x)) AS w, GREATEST(1, MAX(y + GREATEST(1, h)) - MIN(y)) AS h
FROM ocr_units_fx GROUP BY 1""", "ocr_units_fx"))
def q_union(t):
    return box_union(t.ocr_units(), ["slide_id"])


@query("percentile_nearest", """
SELECT l_orderkey, l[CAST(round_even((len(l) - 1) * CAST(0.9 AS DOUBLE), 0) AS BIGINT) + 1] AS p90, l[CAST(round_even((len(l) - 1) * CAST(0.25 AS DOUBLE), 0) AS BIGINT) + 1] AS p25
FROM (SELECT l_orderkey, list_sort(list(l_quantity)) AS l FROM lineitem GROUP BY 1) t""")
def q_percentile(t):
    return nearest_percentiles(t.base("lineitem"), ["l_orderkey"], "l_quantity", {"p90": 0.9, "p25": 0.25})


@query("graphic_scores", with_fixtures(doubles("""
SELECT slide_id, unit_id, round(s, 6) AS score, s >= 2.95 AND words <= 10 AND line_count <= 3 AND w / 1280 <= 0.68 AND y / 720 >= 0.12 AS is_graphic
FROM (SELECT *, len(string_split(source_text, ' ')) AS words,
        CASE WHEN h >= 22 THEN 1.2 WHEN h >= 16 THEN 0.5 ELSE 0.0 END + CASE WHEN x / 4000 >= 0.06 THEN 1.2 WHEN x / 4000 >= 0.04 THEN 0.5 ELSE 0.0 END
        + CASE WHEN unit_id * 6 >= 20 THEN 1.0 WHEN unit_id * 6 >= 14 THEN 0.4 ELSE 0.0 END + CASE WHEN graphic_score_tenths * 2 >= 56 THEN 0.9 WHEN graphic_score_tenths * 2 >= 40 THEN 0.35 ELSE 0.0 END AS s
      FROM ocr_units_fx) t"""), "ocr_units_fx"))
def q_graphic(t):
    c = F.col
    s = graphic_score(c("h"), c("x") / 4000, c("unit_id") * 6, c("graphic_score_tenths") * 2)
    ok = is_graphic(s, F.size(F.split("source_text", " ")), c("line_count"), c("w") / 1280, c("y") / 720)
    return t.ocr_units().select("slide_id", "unit_id", F.round(s, 6).alias("score"), ok.alias("is_graphic"))


NOISY = r"""
nz AS (SELECT s.*, ((a = 0 AND w * h <= 700) OR (a <= 1 AND w * h <= 1200) OR (a <= 2 AND w * h <= 350))
                   AND NOT (list_marker OR role IN ('title', 'subtitle', 'section_heading', 'list_item_level_1', 'list_item_level_2')) AS noise
       FROM (SELECT *, length(regexp_replace(source_text, '[^\p{L}\p{N}]', '', 'g')) AS a, trim(regexp_replace(source_text, '\s+', ' ', 'g')) AS norm FROM slots) s)"""


@query("noise_units", with_fixtures(TO_R7 + "," + NOISY + " SELECT slide_id, unit_id, noise FROM nz", "ocr_units_fx"))
def q_noise(t):
    u = _slotted(t)
    n = is_noise(F.col("role"), F.col("list_marker"), F.length(alnum_only(F.col("source_text"))), F.col("w") * F.col("h"))
    return u.select("slide_id", "unit_id", n.alias("noise"))


def _glossary_rows(t):
    """Translations of the lines of every other document; some are empty and some unchanged."""
    k = F.col("doc_id") % 8
    target = F.when(k == 0, F.lit("")).when(k == 2, F.col("line")).otherwise(F.concat(F.lit("T:"), F.col("line")))
    return t.text_lines().where("doc_id % 2 = 0").groupBy(
        F.trim(F.regexp_replace("line", r"\s+", " ")).alias("source_text_norm")).agg(
        F.min_by(target, F.struct("doc_id", "line_no")).alias("target_text"))


APPLIED = r"""
gl AS (SELECT trim(regexp_replace(line, '\s+', ' ', 'g')) AS norm, arg_min(CASE doc_id % 8 WHEN 0 THEN '' WHEN 2 THEN line ELSE 'T:' || line END, (doc_id, line_no)) AS target
       FROM text_lines_fx WHERE doc_id % 2 = 0 GROUP BY 1),
ap AS (SELECT n.*, CASE WHEN g.norm IS NULL THEN 'missing_glossary_match' WHEN trim(target) = '' THEN 'empty_target_text'
                        WHEN trim(regexp_replace(target, '\s+', ' ', 'g')) = n.norm THEN 'identical' ELSE 'resolved' END AS outcome
       FROM nz n LEFT JOIN gl g ON g.norm = n.norm WHERE role <> 'graphic_embedded' AND NOT noise AND regexp_matches(n.norm, '[\p{L}\p{N}]'))"""


def _applied(t):
    return glossary.apply_glossary(glossary.drop_noise(_slotted(t)), _glossary_rows(t))


@query("apply_glossary", with_fixtures(TO_R7 + "," + NOISY + "," + APPLIED + " SELECT slide_id, unit_id, outcome FROM ap", "ocr_units_fx", "text_lines_fx"))
def q_apply(t):
    return _applied(t).select("slide_id", "unit_id", "outcome")


@query("slide_output_status", with_fixtures(TO_R7 + "," + NOISY + "," + APPLIED + """,
c AS (SELECT slide_id, COUNT(*) FILTER (WHERE outcome = 'resolved') AS rendered_fragments, COUNT(*) FILTER (WHERE outcome IN ('missing_glossary_match', 'empty_target_text')) AS unresolved_fragments,
             COUNT(*) FILTER (WHERE outcome = 'identical') AS identical_fragments FROM ap GROUP BY 1)
SELECT *, CASE WHEN rendered_fragments > 0 AND unresolved_fragments > 0 THEN 'needs_review_partial' WHEN rendered_fragments > 0 THEN 'translated'
               WHEN unresolved_fragments > 0 THEN 'needs_review_unmodified' ELSE 'unchanged' END AS status, unresolved_fragments > 0 AS needs_review FROM c""",
    "ocr_units_fx", "text_lines_fx"))
def q_status(t):
    return glossary.slide_output_status(_applied(t), ["slide_id"])


CANDS = r"""
tx AS (SELECT *, trim(regexp_replace(source_text, '\s+', ' ', 'g')) AS norm FROM slots WHERE role <> 'graphic_embedded'),
ok AS (SELECT * FROM tx WHERE norm <> '' AND regexp_matches(norm, '[\p{L}\p{N}]')),
ex AS (SELECT deck_id, norm, string_agg(raw, '|' ORDER BY first_at) AS examples, arg_min(raw, first_at) AS first_raw
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY deck_id, norm ORDER BY first_at) AS k
             FROM (SELECT deck_id, norm, trim(source_text) AS raw, MIN((slide_index, unit_id)) AS first_at FROM ok GROUP BY 1, 2, 3) q) q2 WHERE k <= 5 GROUP BY 1, 2)"""


def _named_units(t):
    return _slotted(t).withColumn("image_name", F.format_string("event_%03d.png", F.col("slide_index")))


@query("glossary_candidates", with_fixtures(TO_R7 + "," + CANDS + """
SELECT o.deck_id, o.norm AS source_text_norm, first_raw AS source_text, COUNT(*) AS occurrences, array_to_string(list_sort(list_distinct(list(slide_index))), ';') AS slide_indices,
       array_to_string(list_sort(list_distinct(list(event_id))), ';') AS event_ids, array_to_string(list_sort(list_distinct(list(printf('event_%03d.png', slide_index)))), ';') AS image_names,
       examples AS source_examples, MAX(line_count) AS max_line_count, COUNT(*) FILTER (WHERE list_marker) AS list_marker_occurrences
FROM ok o JOIN ex ON ex.deck_id = o.deck_id AND ex.norm = o.norm GROUP BY o.deck_id, o.norm, first_raw, examples""", "ocr_units_fx"))
def q_candidates(t):
    out = glossary.glossary_candidates(_named_units(t), ["deck_id"], ["slide_index", "unit_id"])
    return out.withColumns({c: F.array_join(c, ";") for c in ("slide_indices", "event_ids", "image_names")}).withColumn(
        "source_examples", F.array_join("source_examples", "|"))


@query("glossary_occurrences", with_fixtures(TO_R7 + "," + CANDS + """
SELECT deck_id, norm AS source_text_norm, slide_index, COUNT(*) AS occurrences FROM ok GROUP BY 1, 2, 3""", "ocr_units_fx"))
def q_occurrences(t):
    return glossary.glossary_occurrences(_named_units(t), ["deck_id"])


@query("box_collisions", with_fixtures("""
SELECT a.slide_id, a.unit_id, EXISTS (SELECT 1 FROM ocr_units_fx b WHERE b.slide_id = a.slide_id AND b.unit_id <> a.unit_id
  AND a.x < b.x + GREATEST(1, b.w) + 60 AND b.x < a.x + GREATEST(1, a.w) + 60 AND a.y < b.y + GREATEST(1, b.h) + 60 AND b.y < a.y + GREATEST(1, a.h) + 60) AS collides
FROM ocr_units_fx a""", "ocr_units_fx"))
def q_collisions(t):
    b = t.ocr_units().select("slide_id", "unit_id", "x", "y", "w", "h")
    return glossary.box_collisions(b, b, ["slide_id"], "unit_id", 30).select("slide_id", "unit_id", "collides")


@query("mask_boxes", with_fixtures("""
SELECT slide_id, unit_id, x0 AS x, y0 AS y, GREATEST(1, x1 - x0) AS w, GREATEST(1, y1 - y0) AS h
FROM (SELECT slide_id, unit_id, GREATEST(0, cx - p) AS x0, GREATEST(0, cy - p) AS y0, LEAST(400, cx + cw + p) AS x1, LEAST(300, cy + ch + p) AS y1
      FROM (SELECT *, GREATEST(cx + 1, LEAST(400, cx + w)) - cx AS cw, GREATEST(cy + 1, LEAST(300, cy + h)) - cy AS ch, GREATEST(2, CAST(round_even(LEAST(w, h) * CAST(0.08 AS DOUBLE), 0) AS BIGINT)) AS p
            FROM (SELECT *, GREATEST(0, LEAST(x, 399)) AS cx, GREATEST(0, LEAST(y, 299)) AS cy FROM ocr_units_fx) a) b) c""", "ocr_units_fx"))
def q_masks(t):
    """Boxes grown by a share of their size, inside a 400 x 300 image."""
    pad = F.greatest(F.lit(2), F.bround(F.least("w", "h") * 0.08)).cast("bigint")
    iw, ih = F.lit(400).cast("bigint"), F.lit(300).cast("bigint")
    return t.ocr_units().select("slide_id", "unit_id", *inflate(Box.of(), iw, ih, pad).columns())


@query("expand_boxes", with_fixtures("""
SELECT slide_id, unit_id, GREATEST(0, x - 50) AS x, GREATEST(0, y - 5) AS y, GREATEST(1, LEAST(1280, x + w + 200) - GREATEST(0, x - 50)) AS w,
       GREATEST(1, LEAST(720, y + h + 70) - GREATEST(0, y - 5)) AS h FROM ocr_units_fx""", "ocr_units_fx"))
def q_expand(t):
    iw, ih = F.lit(1280).cast("bigint"), F.lit(720).cast("bigint")
    return t.ocr_units().select("slide_id", "unit_id", *expand(Box.of(), iw, ih, 50, 200, 5, 70).columns())


# Fixed style rows of the query.
STYLES = [
    ("default", "", "font_size", "30"), ("default", "", "font_size_mode", "fixed"), ("default", "", "padding", "0.1 0.2"),
    ("default", "", "text_color", "auto"), ("role", "title", "font_size", "60"), ("role", "body", "font_size_mode", "fit"),
    ("role", "body", "min_font_size", "12"), ("role", "section_heading", "text_color", "#1A2b3c"),
    ("slot", "body.middle_left", "font_size", "22"), ("slot", "body.upper_left", "padding", "1,2,3,4"),
]


def _styled(t):
    styles = t.spark.createDataFrame(STYLES, "level string, key string, name string, value string")
    return glossary.resolve_style(_slotted(t), styles, {
        "font_size": None, "font_size_mode": "fixed", "min_font_size": None, "padding": "", "text_color": ""})


STYLED = """
st AS (SELECT *, CASE WHEN slot_id = 'body.middle_left' THEN 22 WHEN role = 'title' THEN 60 ELSE 30 END AS fs, CASE WHEN role = 'body' THEN 'fit' ELSE 'fixed' END AS mode,
              CASE WHEN slot_id = 'body.upper_left' THEN '1,2,3,4' ELSE '0.1 0.2' END AS pad, CASE WHEN role = 'section_heading' THEN '#1A2b3c' ELSE 'auto' END AS color FROM slots)"""


@query("resolve_style", with_fixtures(TO_R7 + "," + STYLED + """
SELECT slide_id, unit_id, LEAST(48, fs) AS font_size, CASE WHEN mode = 'fixed' THEN LEAST(48, fs) ELSE GREATEST(8, LEAST(LEAST(48, fs), 12)) END AS min_font_size,
       CASE WHEN pad = '1,2,3,4' THEN '1.0;2.0;3.0;4.0' ELSE '0.1;0.2;0.1;0.2' END AS padding, CASE WHEN color = 'auto' THEN '' ELSE '26;43;60' END AS rgb FROM st""", "ocr_units_fx"))
def q_style(t):
    out = glossary.font_sizes(_styled(t), 48)
    return out.select("slide_id", "unit_id", "font_size", "min_font_size",
                      F.array_join(padding_shorthand(F.col("padding")), ";").alias("padding"),
                      F.coalesce(F.array_join(hex_rgb(F.col("text_color")), ";"), F.lit("")).alias("rgb"))


@query("style_metrics", with_fixtures(TO_R7 + """,
col AS (SELECT *, x * 7 % 256 AS r, y * 3 % 256 AS g, w * 11 % 256 AS b FROM slots),
md AS (SELECT deck_id, slot_id, CAST(round_even(median(r), 0) AS BIGINT) AS mr, CAST(round_even(median(g), 0) AS BIGINT) AS mg, CAST(round_even(median(b), 0) AS BIGINT) AS mb FROM col GROUP BY 1, 2)
SELECT slide_id, unit_id, CASE WHEN c.slot_id LIKE 'body.%' THEN mr || ';' || mg || ';' || mb ELSE r || ';' || g || ';' || b END AS rgb
FROM col c JOIN md ON md.deck_id = c.deck_id AND md.slot_id = c.slot_id""", "ocr_units_fx"))
def q_style_metrics(t):
    mode = F.when(F.col("slot_id").startswith("body."), "source_median").otherwise("source_entry")
    rows = _slotted(t).withColumns({"r": F.col("x") * 7 % 256, "g": F.col("y") * 3 % 256, "b": F.col("w") * 11 % 256,
                                    "text_color": F.lit("auto"), "text_color_mode": mode})
    out = glossary.style_metrics(rows, ["deck_id"], _hot(t))
    return out.select("slide_id", "unit_id", F.array_join("text_color_rgb", ";").alias("rgb"))


@query("font_defaults", with_fixtures("""
SELECT slide_id, unit_id, GREATEST(8, CAST(round_even(h / GREATEST(1, line_count) * CAST(0.72 AS DOUBLE), 0) AS BIGINT)) AS font_size FROM ocr_units_fx""", "ocr_units_fx"))
def q_fonts(t):
    return t.ocr_units().select("slide_id", "unit_id", font_default(F.col("h"), F.col("line_count")).alias("font_size"))


def _pages(t):
    """Documents as recognition results: a line is a paragraph, three lines a block.

    The lines are put together as texts; words become nested symbols only then.
    """
    def paragraph(row):
        words = F.transform(F.split(row["line"], " "), lambda w: F.struct(F.array(
            F.struct(F.substring(w, 1, 3).alias("text"), F.lit(None).cast("string").alias("break")),
            F.struct(F.substr(w, F.lit(4)).alias("text"), F.lit("SPACE").alias("break"))).alias("symbols")))
        x, y = (row["line_no"] * 17) % 100, row["line_no"] * 40
        vertices = F.array(*[F.struct(vx.alias("x"), vy.alias("y")) for vx, vy in (
            (x, y), (x + 300, y), (x + 300, y + 30), (x, y + 30))])
        return F.struct(F.lit(0.5).alias("confidence"), vertices.alias("vertices"), words.alias("words"))

    rows = t.text_lines(by_document=True).select("doc_id", "line_no", "line")
    blocks = rows.groupBy("doc_id", F.floor((F.col("line_no") - 1) / 3).alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    pages = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("b", "ls"))).alias("bs"))
    page = F.struct(F.lit(1280).cast("bigint").alias("width"), F.lit(720).cast("bigint").alias("height"),
                    F.transform("bs", lambda b: F.struct(F.transform(b["ls"], paragraph).alias("paragraphs"))).alias("blocks"))
    return pages.select(F.col("doc_id").alias("slide_id"), F.lit(1).cast("bigint").alias("event_id"), F.array(page).alias("pages"))


@query("flatten_ocr", with_fixtures(r"""
SELECT doc_id AS slide_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY line_no) AS fragment_id, dense_b AS block_id,
       ROW_NUMBER() OVER (PARTITION BY doc_id, dense_b ORDER BY line_no) AS line_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text_raw,
       line_no * 17 % 100 AS x, line_no * 40 AS y, 300 AS w, 30 AS h
FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY doc_id ORDER BY (line_no - 1) // 3) AS dense_b
      FROM (SELECT doc_id, line_no, regexp_replace(line, ' +', ' ', 'g') AS line FROM text_lines_fx) a) t""", "text_lines_fx"))
def q_flatten(t):
    return ocr.flatten_ocr(_pages(t), _hot(t)).select(
        "slide_id", "fragment_id", "block_id", "line_id", F.regexp_replace("text_raw", " +", " ").alias("text_raw"), "x", "y", "w", "h")


@query("group_text_units")
def q_group(t):
    """Greedy grouping of fragments; checked against a plain loop in the tests."""
    out = ocr.build_units(ocr.flatten_ocr(_pages(t), _hot(t)))
    return out.select("slide_id", "unit_id", "source_text", "line_count", "list_marker_fragment_id", "x", "y", "w", "h")


@query("group_values", with_fixtures("""
SELECT slide_id, unit_id, median(h) OVER (PARTITION BY slide_id) AS median_h FROM ocr_units_fx""", "ocr_units_fx"))
def q_group_values(t):
    return with_group_values(t.ocr_units(), ["slide_id"], {"median_h": F.median("h")}, _hot(t)).select(
        "slide_id", "unit_id", "median_h")
