"""Queries over frame runs, slide changes and the final deck."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.boxes import Box, clamp_roi, inner_roi, iou
from lectern.functions.measures import histogram_similarity, mad
from lectern.functions.times import event_frame, sample_frames, timecode
from lectern.operators import changes, final_slides
from lectern.plans import final_slides as final_job
from lectern.plans import slide_changes as change_job
from lectern.plans.slide_text_map import slide_text_map
from lectern.settings import staged
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query
from lectern.suite.timed_text import BASE, FLAGSHIP, FRAMED, timed_events

RUNS = ("frame_runs_fx", "transitions_fx", "frame_diffs_fx")

EDGES = """
edges AS (SELECT video_id, prev + 1 AS frame_id_0, f0 + 1 AS frame_id_1, MAX(seg_idx) AS target_seg_idx
          FROM (SELECT *, LAG(f1) OVER (PARTITION BY video_id ORDER BY seg_idx) AS prev FROM frame_runs_fx) t
          WHERE prev IS NOT NULL GROUP BY ALL),
matched AS (SELECT t.*, e.target_seg_idx FROM transitions_fx t LEFT JOIN edges e
            ON t.video_id = e.video_id AND t.frame_id_0 = e.frame_id_0 AND t.frame_id_1 = e.frame_id_1)"""
INITIAL = """
initial AS (SELECT video_id, MIN(seg_idx) AS seg_idx, arg_min(f0, seg_idx) AS f0, arg_min(f1, seg_idx) AS f1
            FROM frame_runs_fx WHERE slide_id >= 0 GROUP BY 1)"""


def stable_sql(runs: str, key: str) -> str:
    return f"""
rd AS (SELECT r.video_id, r.{key}, r.f0, r.f1, d.frame_id, d.diff_milli FROM {runs} r JOIN frame_diffs_fx d
       ON d.video_id = r.video_id AND d.frame_id BETWEEN r.f0 + 1 AND r.f1),
isl AS (SELECT video_id, {key}, n0, COUNT(*) FILTER (WHERE diff_milli <= 120) AS n
        FROM (SELECT *, SUM(CASE WHEN diff_milli > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, {key} ORDER BY frame_id) AS n0
              FROM rd) t GROUP BY 1, 2, 3),
stable AS (SELECT r.video_id, r.{key}, COALESCE(MAX(n) + 1, 1) AS longest_run,
                  COALESCE(MAX(n) + 1, 1) >= 6 AND r.f1 - r.f0 + 1 >= 6 AS has_stable_part
           FROM {runs} r LEFT JOIN isl i ON r.video_id = i.video_id AND r.{key} = i.{key}
           GROUP BY r.video_id, r.{key}, r.f0, r.f1),
picked AS (SELECT r.video_id, r.{key}, CASE WHEN r.f1 <= r.f0 THEN dflt ELSE COALESCE(best, dflt) END AS stable_frame
           FROM (SELECT *, GREATEST(f0, LEAST(f1, f0 + 3)) AS dflt FROM {runs}) r LEFT JOIN (
             SELECT video_id, {key}, arg_min(frame_id, (2 * ahead + diff_milli) * 1000000000 + frame_id) AS best
             FROM (SELECT *, MAX(diff_milli) OVER (PARTITION BY video_id, {key} ORDER BY frame_id RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead
                   FROM rd) t WHERE ahead IS NOT NULL AND frame_id <= f1 - 2 GROUP BY 1, 2) b
             ON r.video_id = b.video_id AND r.{key} = b.{key})"""


SHORT = """
short AS (SELECT * FROM frame_runs_fx WHERE slide_id < 0 AND f1 - f0 + 1 <= 40)"""
BLEND = """
around AS (SELECT r.video_id, r.seg_idx, r.slide_id, r.f0, r.f1, nx.seg_idx AS nseg, nx.slide_id AS nslide, nx.f0 AS nf0, nx.f1 AS nf1,
                  nx.seg_idx IS NULL OR COALESCE(has_stable_part, FALSE) AS keep_short,
                  r.slide_id < 0 AND r.f1 - r.f0 + 1 <= 40 AND NOT COALESCE(has_stable_part, FALSE) AND COALESCE(nx.slide_id >= 0, FALSE) AS moves
           FROM frame_runs_fx r LEFT JOIN frame_runs_fx nx ON nx.video_id = r.video_id AND nx.seg_idx = r.seg_idx + 1
           LEFT JOIN stable s ON s.video_id = r.video_id AND s.seg_idx = r.seg_idx),
blended AS (SELECT m.video_id, m.transition_no, m.frame_id_0, m.frame_id_1, keep_short,
                   CASE WHEN moves THEN nseg ELSE a.seg_idx END AS target_seg_idx, CASE WHEN moves THEN nslide ELSE a.slide_id END AS slide_id,
                   CASE WHEN moves THEN nf0 ELSE a.f0 END AS f0, CASE WHEN moves THEN nf1 ELSE a.f1 END AS f1
            FROM matched m LEFT JOIN around a ON a.video_id = m.video_id AND a.seg_idx = m.target_seg_idx)"""
KEPT = """
kept AS (SELECT * FROM (SELECT b.*, COALESCE(LAG(COALESCE(target_seg_idx, -1)) OVER (PARTITION BY b.video_id ORDER BY transition_no), i.seg_idx, -1) AS prev_seg
                        FROM blended b LEFT JOIN initial i ON i.video_id = b.video_id) t
         WHERE target_seg_idx IS NULL OR target_seg_idx <> prev_seg)"""
CANDIDATES = """
prim AS (SELECT video_id, GREATEST(f0, LEAST(f1, f0 + 3)) AS event_frame, 0 AS sort_priority, f0 AS frame_id_0, f1 AS frame_id_1,
                0 AS transition_no, TRUE AS updates_slide_state, seg_idx FROM initial
         UNION ALL
         SELECT k.video_id, CASE WHEN target_seg_idx IS NULL THEN GREATEST(1, frame_id_1 + 3)
                                 WHEN slide_id < 0 AND f1 - f0 + 1 <= 40 AND keep_short THEN p.stable_frame
                                 ELSE GREATEST(f0, LEAST(f1, f0 + 3)) END,
                0, frame_id_0, frame_id_1, transition_no, COALESCE(slide_id >= 0, TRUE), CASE WHEN slide_id >= 0 THEN target_seg_idx END
         FROM kept k LEFT JOIN picked p ON p.video_id = k.video_id AND p.seg_idx = k.target_seg_idx),
backfill AS (SELECT r.* FROM frame_runs_fx r WHERE slide_id >= 0 AND f1 - f0 + 1 >= 12
             AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.video_id = r.video_id AND p.seg_idx = r.seg_idx)),
cand AS (SELECT * FROM prim UNION ALL
         SELECT video_id, GREATEST(f0, LEAST(f1, f0 + 3)), 1, f0, f1, 0, TRUE, seg_idx FROM backfill)"""
CHAIN = ",".join([EDGES, INITIAL, SHORT, stable_sql("short", "seg_idx"), BLEND, KEPT, CANDIDATES])


@query("match_boundaries", with_fixtures(EDGES + " SELECT * FROM matched", "frame_runs_fx", "transitions_fx"))
def q_match(t):
    return changes.match_boundaries(t.transitions(), t.frame_runs(), t.by_order)


@query("initial_event", with_fixtures(INITIAL + " SELECT * FROM initial", "frame_runs_fx"))
def q_initial(t):
    return changes.initial_events(t.frame_runs())


@query("longest_stable_run", with_fixtures(
    stable_sql("short_runs_fx", "run_no") + " SELECT * FROM stable", "short_runs_fx", "frame_diffs_fx"))
def q_stable(t):
    return changes.longest_stable_run(t.short_runs(), t.frame_diffs(), "run_no", split=t.by_user)


@query("pick_stable_frame", with_fixtures(
    stable_sql("short_runs_fx", "run_no") + " SELECT * FROM picked", "short_runs_fx", "frame_diffs_fx"))
def q_pick(t):
    runs = t.short_runs().withColumn("d", event_frame(F.col("f0"), F.col("f1"), 3, None))
    return changes.pick_stable_frame(runs, t.frame_diffs(), "run_no", "d").select("video_id", "run_no", "stable_frame")


def _blended(t):
    runs = t.frame_runs()
    short = runs.where((F.col("slide_id") < 0) & (F.col("f1") - F.col("f0") + 1 <= 40))
    stable = changes.longest_stable_run(short, t.frame_diffs(), "seg_idx", split=t.by_order or t.by_user)
    matched = changes.match_boundaries(t.transitions(), runs, t.by_order)
    return changes.blend_targets(matched, runs, stable, split=t.by_order)


@query("blend_target", with_fixtures(
    ",".join([EDGES, SHORT, stable_sql("short", "seg_idx"), BLEND]) + """
SELECT video_id, transition_no, target_seg_idx, slide_id FROM blended""", *RUNS))
def q_blend(t):
    return _blended(t).select("video_id", "transition_no", "target_seg_idx", "slide_id")


@query("suppress_repeats", with_fixtures(
    ",".join([EDGES, INITIAL, SHORT, stable_sql("short", "seg_idx"), BLEND, KEPT]) + """
SELECT video_id, transition_no, target_seg_idx FROM kept""", *RUNS))
def q_suppress(t):
    out = changes.suppress_repeats(_blended(t), changes.initial_events(t.frame_runs()), t.by_order)
    return out.select("video_id", "transition_no", "target_seg_idx")


def _candidates(t):
    return change_job.candidates(
        t.frame_runs(), t.transitions(), t.frame_diffs(), split=t.by_order or t.by_user, parts=t.parts("lineitem"))


@query("candidate_union", with_fixtures(CHAIN + " SELECT * FROM cand", *RUNS))
def q_candidates(t):
    """Primary and late candidates together, before numbering."""
    return _candidates(t)


@query("backfill_min", with_fixtures(CHAIN + " SELECT video_id, seg_idx, f0, f1 FROM backfill", *RUNS))
def q_backfill(t):
    """The late candidates of the job: long enough slide runs that no primary candidate covers."""
    late = _candidates(t).where("sort_priority = 1")
    return late.select("video_id", "seg_idx", F.col("frame_id_0").alias("f0"), F.col("frame_id_1").alias("f1"))


@query("uncovered_runs", with_fixtures("""
SELECT video_id, seg_idx FROM frame_runs_fx r WHERE slide_id >= 0 AND NOT EXISTS (
  SELECT 1 FROM transitions_fx x WHERE x.video_id = r.video_id AND x.frame_id_1 = r.f0 + 1)""",
    "frame_runs_fx", "transitions_fx"))
def q_uncovered(t):
    seen = t.transitions().select("video_id", (F.col("frame_id_1") - 1).alias("f0"))
    return t.frame_runs().where("slide_id >= 0").join(seen, ["video_id", "f0"], "left_anti").select("video_id", "seg_idx")


@query("slide_changes", with_fixtures(CHAIN + """
SELECT video_id, event_id, transition_no, frame_id_0, frame_id_1, event_frame, (event_frame - 1) * 40 AS time_ms,
       printf('%02d:%02d:%02d.%03d', (event_frame - 1) * 40 // 3600000, (event_frame - 1) * 40 % 3600000 // 60000,
              (event_frame - 1) * 40 % 60000 // 1000, (event_frame - 1) * 40 % 1000) AS timecode
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY event_frame, sort_priority, frame_id_0, frame_id_1, transition_no) AS event_id
      FROM (SELECT c.* REPLACE (CASE WHEN fc > 0 THEN GREATEST(1, LEAST(fc, event_frame)) ELSE GREATEST(1, event_frame) END AS event_frame)
            FROM cand c LEFT JOIN (SELECT video_id, MAX(f1) - 15 AS fc FROM frame_runs_fx GROUP BY 1) m ON m.video_id = c.video_id) e) c""", *RUNS))
def q_slide_changes(t):
    """Events of videos that end fifteen frames before their last run does."""
    media = t.frame_runs().groupBy("video_id").agg((F.max("f1") - 15).alias("frame_count"))
    return change_job.slide_changes(t.frame_runs(), t.transitions(), t.frame_diffs(), media=media, split=t.by_order or t.by_user, parts=t.parts("lineitem"))


@query("number_events", with_fixtures("""
SELECT video_id, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY frame_id_1, transition_no) AS event_id, transition_no,
       frame_id_0, frame_id_1, frame_id_1 AS event_frame, (frame_id_1 - 1) * 40 AS time_ms,
       printf('%02d:%02d:%02d.%03d', (frame_id_1 - 1) * 40 // 3600000, (frame_id_1 - 1) * 40 % 3600000 // 60000,
              (frame_id_1 - 1) * 40 % 60000 // 1000, (frame_id_1 - 1) * 40 % 1000) AS timecode
FROM transitions_fx""", "transitions_fx"))
def q_number(t):
    rows = t.transitions().withColumns({"event_frame": F.col("frame_id_1"), "sort_priority": F.lit(0)})
    return changes.number_events(rows, split=t.by_order)


def _n_vectors(t):
    """Count of the embeddings as a scalar subquery: all of them serve as pictures."""
    return t.base("embeddings").agg(F.count(F.lit(1))).scalar()


def _pictures(t):
    """The embeddings as pictures of candidate frames."""
    return t.base("embeddings").select("vec_id", F.col("embedding").alias("patch"))


@query("dedupe_backfills", with_fixtures(CHAIN + """,
nn AS (SELECT COUNT(*) AS n FROM embeddings),
ordered AS (SELECT c.*, (video_id + event_frame // 100) % n AS vec,
                   ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY event_frame, sort_priority, frame_id_0, frame_id_1, transition_no) AS rn
            FROM cand c, nn),
fold AS (SELECT video_id, rn, event_frame, sort_priority, TRUE AS stays, vec AS kept, CASE WHEN updates_slide_state THEN vec END AS slide
         FROM ordered WHERE rn = 1
         UNION ALL
         SELECT o.video_id, o.rn, o.event_frame, o.sort_priority, s.stays, CASE WHEN s.stays THEN o.vec ELSE f.kept END,
                CASE WHEN s.stays AND o.updates_slide_state THEN o.vec ELSE f.slide END
         FROM fold f JOIN ordered o ON o.video_id = f.video_id AND o.rn = f.rn + 1,
         LATERAL (SELECT NOT (o.sort_priority = 1 AND (o.vec = f.kept OR (o.updates_slide_state AND COALESCE(o.vec = f.slide, FALSE)))) AS stays) s)
SELECT video_id, event_frame, sort_priority FROM fold WHERE stays""", *RUNS, recursive=True))
def q_dedupe(t):
    """Frames of a video that are close in time show the same picture."""
    shown = (F.col("video_id") + F.floor(F.col("event_frame") / 100)) % _n_vectors(t)
    rows = _candidates(t).withColumn("vec_id", shown)
    out = changes.dedupe_backfills(rows, _pictures(t), 0.0001, split=t.by_order or t.by_user, picture="vec_id")
    return out.select("video_id", "event_frame", "sort_priority")


# -- final deck -------------------------------------------------------------

LABELLED = """
rated AS (SELECT m.*, fb - fa + 1 AS total_frames, CASE WHEN EXISTS (SELECT 1 FROM frame_runs_fx r WHERE r.video_id = m.video_id) THEN
            (SELECT CAST(COALESCE(SUM(LEAST(m.fb, r.f1) - GREATEST(m.fa, r.f0) + 1), 0) AS BIGINT) FROM frame_runs_fx r
             WHERE r.video_id = m.video_id AND r.slide_id < 0 AND r.f0 <= m.fb AND r.f1 >= m.fa) END AS video_frames
          FROM (SELECT *, fa0 AS fa, GREATEST(fa0, CAST(ceil(GREATEST(slide_start_ms, slide_end_ms) * 25 / 1000.0) AS BIGINT)) AS fb
                FROM (SELECT *, GREATEST(1, slide_start_ms * 25 // 1000 + 1) AS fa0 FROM text_map) q) m),
judged AS (SELECT *, slide_end_ms - slide_start_ms AS duration_ms, video_frames / total_frames AS ratio,
                  (event_id * 37 % 30) / 1000.0 AS edge_density, CAST(event_id * 53 % 160 AS DOUBLE) AS laplacian_var
           FROM rated),
labelled AS (SELECT *, COALESCE(NOT is_no_slide AND event_id > 0 AND decision <> 'keep', FALSE) AS is_speaker_only,
                    CASE WHEN is_no_slide THEN 'no_slide_bucket' ELSE decision END AS decision_reason
             FROM (SELECT *, CASE WHEN ratio >= 0.75 THEN 'stage1_video_ratio'
                                  WHEN ratio >= 0.4 AND edge_density <= 0.011 AND laplacian_var <= 80 THEN 'stage1_soft_ratio_plus_low_visual'
                                  WHEN ratio IS NULL AND edge_density <= 0.011 AND laplacian_var <= 80 AND duration_ms <= 2500
                                  THEN 'no_stage1_low_visual_short' ELSE 'keep' END AS decision FROM judged) q)"""
MARKED = """
marked AS (SELECT *, SUM(CASE WHEN is_kept THEN 1 ELSE 0 END) OVER w AS gid, ROW_NUMBER() OVER w AS row_no
           FROM (SELECT *, NOT (is_no_slide OR is_speaker_only) AS is_kept FROM labelled) q
           WINDOW w AS (PARTITION BY video_id ORDER BY slide_start_ms, slide_end_ms, bucket_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
folded AS (SELECT video_id, gid, MAX(CASE WHEN is_kept THEN event_id END) AS event_id, MAX(CASE WHEN is_kept THEN bucket_id END) AS bucket_id,
                  MAX(CASE WHEN is_kept THEN slide_start_ms END) AS slide_start_ms, MAX(slide_end_ms) AS slide_end_ms,
                  MAX(CASE WHEN is_kept THEN target_language END) AS target_language,
                  COALESCE(string_agg(text, ' ' ORDER BY row_no) FILTER (WHERE text <> ''), '') AS text,
                  COALESCE(string_agg(translated_text, ' ' ORDER BY row_no) FILTER (WHERE translated_text <> ''), '') AS translated_text,
                  list_sort(list_distinct(flatten(list(ids)))) AS ids,
                  bool_or(NOT is_kept AND (text <> '' OR translated_text <> '')) AS received
           FROM marked GROUP BY 1, 2)"""
DUPES = """
pics AS (SELECT f.video_id, f.gid, f.event_id, e.embedding AS img FROM folded f
         LEFT JOIN embeddings e ON e.vec_id = (f.video_id * 7 + f.event_id // 3) % (SELECT count(*) FROM embeddings) WHERE f.gid > 0),
chain AS (SELECT video_id, gid, gid AS target_gid, img FROM pics WHERE gid = 1
          UNION ALL
          SELECT p.video_id, p.gid, CASE WHEN s.same THEN c.target_gid ELSE p.gid END, CASE WHEN s.same THEN c.img ELSE p.img END
          FROM chain c JOIN pics p ON p.video_id = c.video_id AND p.gid = c.gid + 1,
          LATERAL (SELECT COALESCE(list_sum(list_transform(list_zip(p.img, c.img), lambda x: abs(x[1] - x[2]))) / len(p.img) <= 0.001, FALSE) AS same) s)"""
COLLAPSED = """
slides AS (SELECT f.video_id, c.target_gid AS gid, MAX(f.slide_end_ms) AS slide_end_ms,
                  COALESCE(string_agg(f.text, ' ' ORDER BY f.gid) FILTER (WHERE f.text <> ''), '') AS text,
                  list_sort(list_distinct(flatten(list(f.ids)))) AS ids
           FROM folded f JOIN chain c ON c.video_id = f.video_id AND c.gid = f.gid GROUP BY 1, 2),
placed AS (SELECT s.video_id, s.gid, k.event_id, k.bucket_id, k.slide_start_ms, s.slide_end_ms, k.target_language, s.text, k.translated_text, s.ids,
                  k.received, ROW_NUMBER() OVER (PARTITION BY s.video_id ORDER BY s.gid) AS slide_index,
                  l.text AS lt, l.translated_text AS ltr, l.ids AS li
           FROM slides s JOIN folded k ON k.video_id = s.video_id AND k.gid = s.gid
           LEFT JOIN folded l ON l.video_id = s.video_id AND l.gid = 0),
final AS (SELECT video_id, slide_index, event_id, bucket_id, slide_start_ms, slide_end_ms, FALSE AS is_no_slide, event_id AS merge_target_event_id,
                 CASE WHEN slide_index = 1 AND NOT received THEN ''
                      WHEN slide_index = 2 AND lt IS NOT NULL THEN trim(lt || ' ' || text) ELSE text END AS text,
                 CASE WHEN slide_index = 1 AND NOT received THEN ''
                      WHEN slide_index = 2 AND (lt <> '' OR len(li) > 0) THEN trim(ltr || ' ' || translated_text) ELSE translated_text END AS translated_text,
                 target_language,
                 CASE WHEN slide_index = 1 AND NOT received THEN []
                      WHEN slide_index = 2 AND li IS NOT NULL THEN list_sort(list_distinct(list_concat(li, ids))) ELSE ids END AS ids
          FROM placed
          UNION ALL
          SELECT video_id, 0, 0, 'no_slide_leading', 0, 0, TRUE, NULL, text, translated_text, '', ids FROM folded f
          WHERE gid = 0 AND (text <> '' OR len(ids) > 0) AND NOT EXISTS (SELECT 1 FROM slides s WHERE s.video_id = f.video_id))"""
DECK = FLAGSHIP + "," + LABELLED + "," + MARKED
DECK_FX = (*BASE, "translations_fx", "frame_runs_fx")


def _metrics(t):
    e = F.col("event_id")
    return t.slide_changes().select(
        "video_id", "event_id", ((e * 37 % 30) / 1000.0).alias("edge_density"),
        (e * 53 % 160).cast("double").alias("laplacian_var"))


def _images(t):
    vec = t.base("embeddings").select("vec_id", F.col("embedding").alias("image"))
    at = (F.col("video_id") * 7 + F.floor(F.col("event_id") / 3)) % _n_vectors(t)
    return t.slide_changes().select("video_id", "event_id", at.alias("vec_id")).join(vec, "vec_id").drop("vec_id")


def _map(t):
    """The slide map as a stage of its own, as the deck job reads it more than once."""
    return staged(slide_text_map(t.segments(), t.slide_changes(), t.translations(), split=t.by_video))


def _labelled(t):
    from lectern.operators.intervals import stage1_video_ratio

    m = _map(t)
    return final_slides.label_rows(m, _metrics(t), stage1_video_ratio(m, t.frame_runs()))


@query("decide_speaker_only", with_fixtures(DECK.replace(MARKED, "").rstrip(",") + """
SELECT video_id, bucket_id, duration_ms, is_speaker_only, decision_reason FROM labelled""", *DECK_FX))
def q_speaker(t):
    return _labelled(t).select("video_id", "bucket_id", "duration_ms", "is_speaker_only", "decision_reason")


@query("fold_into_previous", with_fixtures(DECK + """
SELECT video_id, CAST(gid AS BIGINT) AS gid, event_id, slide_end_ms, text, translated_text, array_to_string(ids, ';') AS ids, received AS received_text
FROM folded""", *DECK_FX))
def q_fold(t):
    out = final_slides.fold_into_previous(final_slides.mark_folds(_labelled(t), t.by_video))
    return out.select("video_id", "gid", "event_id", "slide_end_ms", "text", "translated_text",
                      F.array_join("source_segment_ids", ";").alias("ids"), "received_text")


@query("collapse_near_duplicates", with_fixtures(DECK + "," + DUPES + """
SELECT video_id, CAST(gid AS BIGINT) AS gid, CAST(target_gid AS BIGINT) AS target_gid FROM chain""",
    *DECK_FX, recursive=True))
def q_duplicates(t):
    folded = final_slides.fold_into_previous(final_slides.mark_folds(_labelled(t), t.by_video))
    out = final_slides.duplicate_targets(folded, _images(t), 0.001)
    return out.where("gid > 0").select("video_id", "gid", "target_gid")


def _final(t):
    return final_job.final_slides(
        _map(t), t.frame_runs(), _metrics(t), _images(t), duplicate_threshold=0.001, split=t.by_video)


@query("final_slides", with_fixtures(DECK + "," + DUPES + "," + COLLAPSED + """
SELECT * EXCLUDE (ids), array_to_string(ids, ';') AS source_segment_ids, len(ids) AS segments_count FROM final""",
    *DECK_FX, recursive=True))
def q_final(t):
    return _final(t)[0].withColumn("source_segment_ids", F.array_join("source_segment_ids", ";"))


@query("leading_text", with_fixtures(DECK + "," + DUPES + "," + COLLAPSED + """
SELECT video_id, slide_index, text, array_to_string(ids, ';') AS ids FROM final WHERE slide_index <= 2""",
    *DECK_FX, recursive=True))
def q_leading(t):
    """The first two slides, where text from before the first slide ends up."""
    return _final(t)[0].where("slide_index <= 2").select(
        "video_id", "slide_index", "text", F.array_join("source_segment_ids", ";").alias("ids"))


@query("filter_manifest", with_fixtures(DECK + "," + DUPES + """,
moved AS (SELECT p.video_id, p.event_id, k.event_id AS dup FROM chain c JOIN pics p ON p.video_id = c.video_id AND p.gid = c.gid
          JOIN pics k ON k.video_id = c.video_id AND k.gid = c.target_gid WHERE c.gid <> c.target_gid)
SELECT m.video_id, m.event_id, m.bucket_id, slide_start_ms, slide_end_ms, duration_ms, is_no_slide, is_speaker_only,
       CASE WHEN dup IS NOT NULL THEN 'duplicate_slide' ELSE decision_reason END AS decision_reason,
       CASE WHEN dup IS NOT NULL THEN 'merged_duplicate_slide' WHEN is_kept THEN 'keep' WHEN gid = 0 THEN 'leading_no_previous'
            WHEN gid = 1 THEN 'merged_to_thumbnail' ELSE 'merged_to_previous' END AS action,
       CASE WHEN dup IS NOT NULL THEN dup WHEN NOT is_kept THEN (SELECT f.event_id FROM folded f WHERE f.video_id = m.video_id AND f.gid = m.gid) END AS merge_target_event_id,
       CASE WHEN m.event_id > 0 THEN round(edge_density, 6) END AS edge_density, CASE WHEN m.event_id > 0 THEN round(laplacian_var, 3) END AS laplacian_var,
       round(ratio, 4) AS stage1_video_ratio, length(text) AS text_len
FROM marked m LEFT JOIN moved d ON d.video_id = m.video_id AND d.event_id = m.event_id""", *DECK_FX, recursive=True))
def q_manifest(t):
    return _final(t)[1]


@query("stage_counters", with_fixtures(DECK + """
SELECT video_id, COUNT(*) AS original_count, COUNT(*) FILTER (WHERE is_kept) AS kept_count,
       COUNT(*) FILTER (WHERE NOT is_kept) AS removed_count, COUNT(*) FILTER (WHERE is_speaker_only) AS speaker_only_count
FROM marked GROUP BY 1""", *DECK_FX))
def q_counters(t):
    from lectern.operators.runs import stage_counters

    marked = final_slides.mark_folds(_labelled(t), t.by_video)
    return stage_counters(marked, ["video_id"], {
        "kept_count": F.col("kept"), "removed_count": ~F.col("kept"), "speaker_only_count": F.col("is_speaker_only"),
    }, total="original_count")


def _people(t):
    roi = Box(*[F.lit(v).cast("bigint") for v in (160, 90, 960, 540)])
    return final_slides.person_rollup(t.person_boxes(), roi, 1280, 720, ["video_id"])


PEOPLE = """
hits AS (SELECT video_id, frame_no, weight_pct,
                w * h >= 0.02 * 1280 * 720 AND 1.0 - GREATEST(0, LEAST(x + w, 1120) - GREATEST(x, 160)) * GREATEST(0, LEAST(y + h, 630) - GREATEST(y, 90)) / (w * h) >= 0.35 AS hit
         FROM person_boxes_fx),
pf AS (SELECT video_id, frame_no, bool_or(hit) AS found, MAX(weight_pct) FILTER (WHERE hit) AS top FROM hits GROUP BY 1, 2),
people AS (SELECT video_id, COUNT(*) AS sample_frames, COUNT(*) FILTER (WHERE found) AS person_detected_frames,
                  bool_or(found) AS person_present, COALESCE(MAX(top), 0) AS person_max_weight_pct FROM pf GROUP BY 1)"""


@query("person_rollup", with_fixtures(PEOPLE + " SELECT * FROM people", "person_boxes_fx"))
def q_people(t):
    return _people(t)


def _sides(t):
    side = F.element_at(F.array(*[F.lit(s) for s in ("left", "right", "top", "bottom")]),
                        (F.col("l_suppkey") % 4 + 1).cast("int"))
    return t.base("lineitem").select(
        (F.col("l_orderkey") % 500).alias("video_id"), F.col("l_linenumber").alias("frame_no"), side.alias("side"),
        F.col("l_quantity").alias("diff"))


BORDER = """
sides AS (SELECT l_orderkey % 500 AS video_id, l_linenumber AS frame_no, ['left', 'right', 'top', 'bottom'][l_suppkey % 4 + 1] AS side, l_quantity AS diff FROM lineitem),
bf AS (SELECT video_id, frame_no, COUNT(*) FILTER (WHERE diff <= 6) AS matched FROM sides GROUP BY 1, 2),
border0 AS (SELECT video_id, COUNT(*) AS sample_frames, COUNT(*) FILTER (WHERE matched >= 2) AS matched_frame_count,
                   CAST(round_even(median(matched), 0) AS BIGINT) AS median_matched_sides FROM bf GROUP BY 1),
border AS (SELECT b.*, side_diff_left, side_diff_right, side_diff_top, side_diff_bottom, matched_frame_count >= GREATEST(1, ceil(sample_frames / 2.0)) AS slide_extension_detected
           FROM border0 b JOIN (SELECT video_id, round(median(diff) FILTER (WHERE side = 'left'), 3) AS side_diff_left, round(median(diff) FILTER (WHERE side = 'right'), 3) AS side_diff_right,
                                       round(median(diff) FILTER (WHERE side = 'top'), 3) AS side_diff_top, round(median(diff) FILTER (WHERE side = 'bottom'), 3) AS side_diff_bottom
                                FROM sides GROUP BY 1) m ON m.video_id = b.video_id)"""


SOURCE = """
src AS (SELECT f.video_id, f.slide_index, f.event_id, f.text, f.event_id % 5 <> 4 AS has_full, person_present AS pp, person_detected_frames AS pn, p.sample_frames AS sn,
               slide_extension_detected AS ext, median_matched_sides AS ms
        FROM final f LEFT JOIN people p ON p.video_id = f.video_id LEFT JOIN border b ON b.video_id = f.video_id),
moded AS (SELECT *, COALESCE(pp, FALSE) AS here, COALESCE(ext, FALSE) AS wide, COALESCE(pn, 0) AS frames, COALESCE(ms, 0) AS sides, COALESCE(sn, 0) AS samples FROM src)"""


@query("job_final_deck", with_fixtures(DECK + "," + DUPES + "," + COLLAPSED + "," + PEOPLE + "," + BORDER + "," + SOURCE + """
SELECT video_id, slide_index, event_id, text,
  CASE WHEN slide_index = 1 OR (has_full AND samples > 0 AND NOT here AND wide) THEN 'full' ELSE 'slide' END AS source_mode,
  CASE WHEN slide_index = 1 THEN 'thumbnail_always_full' WHEN NOT has_full THEN 'no_full_image' WHEN samples <= 0 THEN 'no_sample_frames'
       WHEN NOT here AND wide THEN 'person_absent_and_border_match' WHEN here THEN 'person_detected_outside_roi' ELSE 'border_match_insufficient' END AS source_reason,
  CAST(CASE WHEN slide_index = 1 THEN 100 WHEN NOT has_full THEN 0 WHEN samples <= 0 THEN 0 WHEN NOT here AND wide THEN LEAST(99, 55 + 10 * LEAST(4, sides))
       WHEN here THEN LEAST(99, 40 + 10 * frames) ELSE GREATEST(0, LEAST(95, 20 + 8 * sides)) END AS BIGINT) AS source_confidence_pct
FROM moded""", *DECK_FX, "person_boxes_fx", recursive=True))
def q_final_deck(t):
    """The final deck with the source mode of every slide, from the people and borders seen in its video."""
    border = final_slides.border_rollup(_sides(t), ["video_id"], threshold=6.0).drop("sample_frames")
    final, _manifest = final_job.final_slides(
        _map(t), t.frame_runs(), _metrics(t), _images(t), duplicate_threshold=0.001, people=_people(t), borders=border,
        full_images=F.col("event_id") % 5 != 4, split=t.by_video)
    return final.select("video_id", "slide_index", "event_id", "text", "source_mode", "source_reason", "source_confidence_pct")


@query("border_rollup", BORDER.replace("\nsides AS", "WITH sides AS", 1) + " SELECT * FROM border")
def q_border(t):
    return final_slides.border_rollup(_sides(t), ["video_id"], threshold=6.0)


@query("decide_source_mode", with_fixtures(PEOPLE + "," + BORDER + """,
r AS (SELECT p.video_id, p.video_id % 7 + 1 AS slide_index, p.video_id % 5 <> 4 AS has_full, person_present AS pp, person_detected_frames AS pn,
             slide_extension_detected AS ext, median_matched_sides AS ms FROM people p JOIN border b ON b.video_id = p.video_id)
SELECT video_id, slide_index,
  CASE WHEN slide_index = 1 OR (has_full AND NOT pp AND ext) THEN 'full' ELSE 'slide' END AS source_mode,
  CASE WHEN slide_index = 1 THEN 'thumbnail_always_full' WHEN NOT has_full THEN 'no_full_image' WHEN NOT pp AND ext THEN 'person_absent_and_border_match'
       WHEN pp THEN 'person_detected_outside_roi' ELSE 'border_match_insufficient' END AS source_reason,
  CASE WHEN slide_index = 1 THEN 100 WHEN NOT has_full THEN 0 WHEN NOT pp AND ext THEN LEAST(99, 55 + 10 * LEAST(4, ms))
       WHEN pp THEN LEAST(99, 40 + 10 * pn) ELSE GREATEST(0, LEAST(95, 20 + 8 * ms)) END AS source_confidence_pct
FROM r""", "person_boxes_fx"))
def q_source_mode(t):
    border = final_slides.border_rollup(_sides(t), ["video_id"], threshold=6.0).drop("sample_frames")
    rows = _people(t).join(border, "video_id").withColumns(
        {"slide_index": F.col("video_id") % 7 + 1, "has_full_image": F.col("video_id") % 5 != 4})
    return final_slides.decide_source_mode(rows).select(
        "video_id", "slide_index", "source_mode", "source_reason", "source_confidence_pct")


# -- frames and arrays --------------------------------------------------------

@query("sample_frames", with_fixtures(FRAMED + """
SELECT video_id, event_id, array_to_string(CASE WHEN fb <= fa THEN [GREATEST(1, CAST(round_even((fa + fb) / 2.0, 0) AS BIGINT))]
  ELSE list_sort(list_distinct(list_transform([0, 1, 2, 3, 4], lambda i: GREATEST(1, CAST(round_even(fa + i * (fb - fa) / 4.0, 0) AS BIGINT))))) END, ';') AS frames
FROM framed""", "slide_changes_fx"))
def q_samples(t):
    from lectern.functions.times import frame_interval

    a, b = frame_interval(F.col("slide_start_ms"), F.col("slide_end_ms"), F.lit(25))
    return timed_events(t).select("video_id", "event_id", F.array_join(sample_frames(a, b, 5), ";").alias("frames"))


@query("event_frames", with_fixtures("""
SELECT video_id, seg_idx, GREATEST(1, LEAST(600, GREATEST(f0, LEAST(f1, f0 + 3)))) AS event_frame,
       printf('%02d:%02d:%02d.%03d', f0 * 40 // 3600000, f0 * 40 % 3600000 // 60000, f0 * 40 % 60000 // 1000, f0 * 40 % 1000) AS timecode
FROM frame_runs_fx""", "frame_runs_fx"))
def q_event_frames(t):
    return t.frame_runs().select(
        "video_id", "seg_idx", event_frame(F.col("f0"), F.col("f1"), 3, F.lit(600)).alias("event_frame"),
        timecode(F.col("f0") * 40).alias("timecode"))


@query("regions", with_fixtures("""
SELECT video_id, frame_no, x, y, cx0, cy0, cx1, cy1,
       CASE WHEN ok THEN cx0 + dx ELSE cx0 END AS ix0, CASE WHEN ok THEN cy0 + dy ELSE cy0 END AS iy0,
       CASE WHEN ok THEN cx1 - dx ELSE cx1 END AS ix1, CASE WHEN ok THEN cy1 - dy ELSE cy1 END AS iy1
FROM (SELECT *, cx1 - dx > cx0 + dx AND cy1 - dy > cy0 + dy AS ok
      FROM (SELECT *, CAST(round_even((cx1 - cx0) * 0.1, 0) AS BIGINT) AS dx, CAST(round_even((cy1 - cy0) * 0.08, 0) AS BIGINT) AS dy
            FROM (SELECT *, GREATEST(cx0 + 1, LEAST(x + w, 1280)) AS cx1, GREATEST(cy0 + 1, LEAST(y + h, 720)) AS cy1
                  FROM (SELECT *, GREATEST(0, LEAST(x, 1279)) AS cx0, GREATEST(0, LEAST(y, 719)) AS cy0 FROM person_boxes_fx) a) b) c) d""",
    "person_boxes_fx"))
def q_regions(t):
    """Regions forced into the frame, and the same without their rim."""
    x, y, w, h = [F.col(c) for c in "xywh"]
    b = t.person_boxes()
    roi = clamp_roi(x, y, x + w, y + h, F.lit(1280).cast("bigint"), F.lit(720).cast("bigint"))
    c = b.select("video_id", "frame_no", "x", "y", *[v.alias(n) for v, n in zip(roi, ("cx0", "cy0", "cx1", "cy1"))])
    inner = inner_roi(*[F.col(n) for n in ("cx0", "cy0", "cx1", "cy1")])
    return c.select("*", *[v.alias(n) for v, n in zip(inner, ("ix0", "iy0", "ix1", "iy1"))])


@query("box_overlap", with_fixtures("""
SELECT video_id, frame_no, x, y, inter, CASE WHEN inter = 0 THEN 0.0 ELSE round(inter / (w * h + 960 * 540 - inter), 6) END AS iou
FROM (SELECT *, GREATEST(0, LEAST(x + w, 1120) - GREATEST(x, 160)) * GREATEST(0, LEAST(y + h, 630) - GREATEST(y, 90)) AS inter FROM person_boxes_fx) t""",
    "person_boxes_fx"))
def q_iou(t):
    from lectern.functions.boxes import intersection

    roi = Box(*[F.lit(v).cast("bigint") for v in (160, 90, 960, 540)])
    return t.person_boxes().select("video_id", "frame_no", "x", "y", intersection(Box.of(), roi).alias("inter"),
                                   F.round(iou(Box.of(), roi), 6).alias("iou"))


def _pairs(t):
    """Every picture with the next one of the same label."""
    from lectern.operators.scan import OrderedScan

    e = t.base("embeddings")
    return OrderedScan(e, ["label"], ["vec_id"]).lag("other", "embedding").apply(t.split("embeddings", "label"))


@query("array_distance", """
SELECT vec_id, CASE WHEN other IS NULL THEN CAST('inf' AS DOUBLE)
  ELSE round(list_sum(list_transform(list_zip(embedding, other), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) / len(embedding), 6) END AS mad
FROM (SELECT *, LAG(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings) t""")
def q_mad(t):
    return _pairs(t).select("vec_id", F.round(mad(F.col("embedding"), F.col("other")), 6).alias("mad"))


@query("histogram_similarity", """
SELECT vec_id, round(r, 4) AS similarity, r >= 0.1 AS passed
FROM (SELECT vec_id, list_aggregate(list_transform(list_zip(a, b), lambda x: (x[1] - list_avg(a)) * (x[2] - list_avg(b))), 'sum')
        / sqrt(list_aggregate(list_transform(a, lambda x: (x - list_avg(a)) ** 2), 'sum') * list_aggregate(list_transform(b, lambda x: (x - list_avg(b)) ** 2), 'sum')) AS r
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(LAG(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings) t
      WHERE b IS NOT NULL) q""")
def q_histogram(t):
    passed, sim = histogram_similarity(F.col("embedding"), F.col("other"), 0.1)
    return _pairs(t).where("other IS NOT NULL").select("vec_id", sim.alias("similarity"), passed.alias("passed"))
