"""Composite jobs over small tables, where SQL has no word for a part of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import memory
from lectern.plans import jobs

SEGMENTS = "video_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string"
TERMS = "pos bigint, source_text string, target_language string, target_text string, case_sensitive string"


def _translate(spark, texts, model, max_count=1):
    segments = spark.createDataFrame([(1, i, i * 10, i * 10 + 5, t) for i, t in enumerate(texts, start=1)], SEGMENTS)
    entries = spark.createDataFrame([], "source_text_norm string, target_language string, target_text string")
    terms = memory.select_termbase(spark.createDataFrame([(1, "Zug", "*", "train", "0")], TERMS), "en")
    given = spark.createDataFrame([(p, "en", t) for p, t in model.items()], "protected_text string, target_language string, translated_text string")
    out = memory.translate_with_memory(segments, entries, terms, given, "en", max_count, 400)
    return [(r.translated_text, r.translation_status, r.termbase_hits) for r in out.orderBy("segment_id").collect()]


def test_a_later_spelling_is_translated_and_remembered(spark):
    got = _translate(spark, ["der  Bus", "der Bus", "der   Bus", "der Bus"], {"der Bus": "the bus"})
    assert got == [("der  Bus", "source_fallback", 0), ("the bus", "translated", 0), ("the bus", "tm_exact", 0), ("the bus", "tm_exact", 0)]


def test_the_last_of_a_chunk_is_what_later_chunks_find(spark):
    got = _translate(spark, ["ein Tag", "ein  Tag", "ein Tag"], {"ein Tag": "a day", "ein  Tag": "one day"}, max_count=2)
    assert got == [("a day", "translated", 0), ("one day", "translated", 0), ("one day", "tm_exact", 0)]


def test_terms_are_counted_where_a_translation_came(spark):
    got = _translate(spark, ["der Zug", "kein Zug"], {"der __TERM_0001__": "the __TERM_0001__"})
    assert got == [("the train", "translated_with_termbase", 1), ("kein Zug", "source_fallback", 0)]


def test_graphic_scores_are_an_input_of_the_deck_glossary(spark):
    from conftest import SMALL

    from lectern.suite import decks
    from lectern.suite.fixtures import Tables

    t = Tables(spark, SMALL)
    pages = decks._pages(t)
    about = pages.withColumns({
        "deck_id": F.lit(1).cast("bigint"), "slide_index": F.col("slide_id"), "event_id": F.col("slide_id"),
        "image_name": F.concat(F.lit("s"), F.col("slide_id").cast("string")), "image_w": F.lit(1280).cast("bigint"), "image_h": F.lit(720).cast("bigint")})
    about = about.select("deck_id", "slide_id", "slide_index", "event_id", "image_name", "image_w", "image_h", "pages")
    terms = spark.createDataFrame([], TERMS)
    plain = {r.source_text_norm for r in jobs.deck_glossary(about, terms, "de")[1].collect()}
    scores = about.select("slide_id", F.explode(F.sequence(F.lit(1), F.lit(300)).cast("array<bigint>")).alias("unit_id"), F.lit(4.0).alias("graphic_score"))
    drawn = {r.source_text_norm for r in jobs.deck_glossary(about, terms, "de", graphics=scores)[1].collect()}
    # only short texts can belong to a graphic
    assert drawn < plain and all(len(text.split()) <= 10 for text in plain - drawn)
