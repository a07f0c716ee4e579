"""The other composite jobs; each takes and returns DataFrames of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import consistency, glossary, memory, ocr, roles, runs, speech, timeline
from lectern.settings import has_hot_key, staged


def translated_segments(
    segments: DataFrame, entries: DataFrame, terms: DataFrame, translations: DataFrame, language: str, now: Column,
) -> tuple[DataFrame, DataFrame]:
    """Translated segments and the memory after the batch.

    ``terms`` are raw termbase rows; ``translations`` the model's output for protected texts.
    """
    rows = staged(memory.translate_with_memory(
        segments, entries, memory.select_termbase(terms, language), translations, language))
    fresh = rows.where(F.col("translation_status").startswith("translated")).select(
        F.col("video_id").cast("string").alias("run_id"),
        F.struct("start_ms", "end_ms", "segment_id").alias("pos"), "target_language",
        F.col("text").alias("source_text"), F.col("translated_text").alias("target_text"))
    merged = memory.tm_merge(entries, fresh, now)
    hits = rows.select("source_text_norm", "target_language", (F.col("tm_exact_hit") == 1).alias("tm_exact_hit"))
    return rows, memory.tm_add_hits(merged, hits, now)


def deck_glossary(
    images: DataFrame, terms: DataFrame, language: str, batch_size: int = 32, graphics: DataFrame | None = None, split: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Frozen entries from the termbase, and the other candidates in batches to be translated.

    ``images``: deck_id, slide_id, slide_index, event_id, image_name, image_w,
    image_h, pages. ``graphics(slide_id, unit_id, graphic_score)`` is how much the
    pixels of a unit look like a graphic; units without a score are text.
    """
    about = images.select("deck_id", "slide_id", "slide_index", "image_name", "image_w", "image_h")
    units = ocr.build_units(ocr.flatten_ocr(images.select("slide_id", "event_id", "pages"), split)).join(about, "slide_id")
    scored = units.withColumn("graphic_score", F.lit(0.0))
    if graphics is not None:
        scores = graphics.groupBy(F.col("slide_id").alias("__slide"), F.col("unit_id").alias("__unit")).agg(F.max("graphic_score").alias("__score"))
        met = F.col("slide_id").eqNullSafe(F.col("__slide")) & (F.col("unit_id") == F.col("__unit"))
        scored = scored.join(scores, met, "left").withColumn("graphic_score", F.coalesce("__score", F.lit(0.0))).drop("__slide", "__unit", "__score")
    classified = roles.classify_units(scored, split)
    candidates = staged(glossary.glossary_candidates(classified, ["deck_id"], ["slide_index", "unit_id"]))
    frozen, pending = memory.match_termbase(candidates, memory.select_termbase(terms, language))
    return frozen, memory.number_batches(pending, ["deck_id"], ["source_text_norm"], batch_size, split)


def glossary_application(classified: DataFrame, entries: DataFrame, keys: list[str], policy: str = "partial") -> tuple[DataFrame, DataFrame]:
    """Outcome of every unit and status of every slide."""
    outcomes = glossary.apply_glossary(glossary.drop_noise(classified), entries)
    return outcomes, glossary.slide_output_status(outcomes, keys, policy)


#: style values of a rendered text and what they are without a style table
STYLE_NAMES = {
    "font_size": None, "font_size_mode": "fixed", "min_font_size": None, "padding": "", "text_color": "", "text_color_mode": "source_median",
}


def rendered_units(
    classified: DataFrame, entries: DataFrame, styles: DataFrame, keys: list[str], *, font_cap: int = 48, margin: int = 2,
    policy: str = "partial", split: bool | None = None,
) -> dict[str, DataFrame]:
    """What a renderer of translated slides needs: the resolved units with style, colour and collisions, statuses, counters.

    ``classified`` has the columns r, g, b of each unit's own text colour beside
    those of ``glossary_application``. A resolved unit collides when its box,
    grown by ``margin``, touches another unit of its slide.
    """
    outcomes, statuses = glossary_application(classified, entries, keys, policy)
    outcomes = staged(outcomes)
    resolved = outcomes.where(F.col("outcome") == "resolved")
    styled = glossary.font_sizes(glossary.resolve_style(resolved, styles, STYLE_NAMES), font_cap)
    coloured = glossary.style_metrics(styled, ["deck_id"], split)
    boxes = ["slide_id", "unit_id", "x", "y", "w", "h"]
    met = glossary.box_collisions(resolved.select(*boxes), outcomes.select(*boxes), ["slide_id"], "unit_id", margin)
    units = coloured.join(met.select("slide_id", "unit_id", "collides"), ["slide_id", "unit_id"])
    counters = runs.stage_counters(outcomes, ["deck_id"], {
        "resolved_count": F.col("outcome") == "resolved", "identical_count": F.col("outcome") == "identical",
        "missing_count": F.col("outcome") == "missing_glossary_match", "empty_count": F.col("outcome") == "empty_target_text"}, total="unit_count")
    return {"units": units, "statuses": statuses, "counters": counters}


def speech_plan(segments: DataFrame, prompt_bytes: int) -> DataFrame:
    """Speech chunks of each video with their segments and joined text."""
    packed = memory.pack_speech_chunks(segments, prompt_bytes)
    text = F.coalesce(F.nullif(F.trim("translated_text"), F.lit("")), F.trim("text"))
    part = F.struct("start_ms", "end_ms", "segment_id", text.alias("text"))
    return (
        segments.join(packed, ["video_id", "segment_id"])
        .groupBy("video_id", "chunk_index", "mode")
        .agg(F.array_sort(F.collect_list(part)).alias("ps"), F.bool_or("oversize").alias("oversize"))
        .select("video_id", "chunk_index", "mode", "oversize", F.transform("ps", lambda p: p["segment_id"]).alias("segment_ids"),
                F.array_join(F.transform("ps", lambda p: p["text"]), " ").alias("tts_text"))
    )


def speech_alignment(segments: DataFrame, chunks: DataFrame, words: DataFrame, split: bool | None = None) -> DataFrame:
    """Speech times of all segments.

    ``chunks``: video_id, chunk_index, segment_ids, tts_text, asr_text, status,
    duration_ms; ``words``: video_id, chunk_index, word_no, start_ms, end_ms.
    """
    placed = speech.chunk_timeline(chunks, split).select(
        "video_id", "chunk_index", F.explode("segment_ids").alias("segment_id"), F.col("start_ms").alias("chunk_start_ms"),
        F.col("end_ms").alias("chunk_end_ms"), F.col("tts_text").alias("chunk_text"), "asr_text")
    text = F.coalesce(F.nullif(F.trim("translated_text"), F.lit("")), F.trim("text"))
    own = segments.select("video_id", "segment_id", F.col("start_ms").alias("source_start_ms"),
                          F.col("end_ms").alias("source_end_ms"), text.alias("tts_text"))
    timed = speech.choose_alignment(placed.join(own, ["video_id", "segment_id"]), words, split=split)
    return timed.join(own.drop("tts_text"), ["video_id", "segment_id"])


def playback(slides: DataFrame, alignment: DataFrame, words: DataFrame | None, *, intro_ms: int = 0, outro_ms: int = 0,
             split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Timeline and subtitle cues: over one speech track when words are given, else slide by slide.

    ``slides``: video_id, slide_index, event_id, bucket_id, slide_start_ms,
    slide_end_ms, text, translated_text, source_segment_ids.
    """
    if split is None:
        split = has_hot_key(slides.select("video_id"), ["video_id"])
    windows = timeline.slide_audio_window(slides, alignment)
    if words is None:
        rows = timeline.timeline_segmented(slides, windows, split=split)
    else:
        totals = alignment.groupBy("video_id").agg(F.max("tts_end_ms").alias("total_ms"))
        # a video without any alignment stays, with no speech
        whole = slides.join(totals, "video_id", "left").withColumn("total_ms", F.coalesce("total_ms", F.lit(0).cast("bigint")))
        matches = timeline.match_phrases(slides, timeline.candidate_words(slides, alignment, words))
        times = whole.select("video_id", F.col("slide_index").alias("time_id"), F.col("slide_end_ms").alias("source_ms"), "total_ms")
        projected = timeline.project_time(times, alignment, timeline.word_boundaries(words), split=split).withColumnRenamed(
            "time_id", "slide_index")
        rows = timeline.timeline_master(
            whole, matches.select("video_id", "slide_index", "match_start_ms", "match_end_ms"), projected, windows, split=split)
    rows = staged(timeline.shift_timeline(rows, intro_ms, outro_ms, split))
    return rows, timeline.subtitle_cues(rows, split)


def deck_consistency(original: DataFrame, translated: DataFrame, split: bool | None = None) -> dict[str, DataFrame]:
    """Sequences, leftovers, first issue per slide, report, distinct glossary pairs of decks, and the glossary each slide goes by.

    Every step groups or joins by deck. Where both tables are partitioned by
    ``deck_id`` alone, no step shuffles the texts again, and computing a step
    once more is cheaper than keeping its texts in the checkpoint folder.
    """
    if split is None:
        split = has_hot_key(original.select("deck_id"), ["deck_id"])
    sequences = consistency.build_sequences(consistency.text_sets(original), split)
    mapping = consistency.element_mapping(original, translated)
    issues = consistency.leftover_check(translated, sequences, mapping)
    pairs = consistency.element_pairs(original, translated)
    texts = original.select("deck_id", "slide_index", F.trim("text").alias("original")).distinct()
    running = consistency.slide_glossary(texts, consistency.glossary_intervals(pairs, split), sequences, mapping)
    return {
        "slide_glossary": running,
        "sequences": sequences, "issues": issues, "first_issues": consistency.first_issues(issues),
        "report": consistency.consistency_report(sequences, issues, original), "glossary": consistency.distinct_pairs(mapping, sequences),
    }


def run_overview(
    files: DataFrame, items: DataFrame, config: DataFrame, status: DataFrame, parts: DataFrame | None = None, needs: dict[str, Column] | None = None,
) -> DataFrame:
    """Catalogue of runs; ``files(run_id, kind, mtime)``.

    With ``parts`` (see ``runs.level_counts``) the readiness flags come from
    tables and folders, and ``needs`` on those flags tells what a run still
    lacks.
    """
    kinds = [level for level, _text in runs.ARTIFACT_LEVELS]
    costs = runs.run_cost(items).select("run_id", "cost_e7_usd")
    catalog = runs.run_catalog(runs.artifact_counts(files, kinds), costs, config, status)
    if parts is None:
        return catalog
    ready = runs.run_readiness(parts)
    flags = [c for c in ready.columns if c != "run_id"]
    joined = catalog.drop(*flags).join(ready, "run_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags if c.endswith("_ready")})
    return runs.missing_requirements(joined, needs or {})


__all__ = [
    "deck_consistency", "deck_glossary", "glossary_application", "playback", "rendered_units", "run_overview", "speech_alignment",
    "speech_plan", "translated_segments",
]
