"""Sequences of growing slides and the consistency of their translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.operators.grouped import looked_up, with_group_values
from lectern.operators.scan import OrderedScan

SLIDE = ["deck_id", "slide_index"]


def norm(text: Column) -> Column:
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def text_sets(elements: DataFrame) -> DataFrame:
    """Distinct folded texts of each slide."""
    t = norm(F.col("text"))
    return elements.groupBy(*SLIDE).agg(F.array_sort(F.collect_set(F.when(t != "", t))).alias("texts"))


def is_strict_subset(a: Column, b: Column) -> Column:
    """All of non-empty ``a`` is in ``b``, and ``b`` has more."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0) & (F.size(b) > F.size(a))


def build_sequences(sets: DataFrame, split: bool | None = None) -> DataFrame:
    """Runs of slides that each contain all texts of the one before; at least two slides."""
    chained = OrderedScan(sets, ["deck_id"], ["slide_index"]).lag("__before", "texts").apply(split)
    breaks = F.when(F.coalesce(is_strict_subset(F.col("__before"), F.col("texts")), F.lit(False)), 0).otherwise(1)
    runs = (
        OrderedScan(chained.withColumn("__break", breaks.cast("bigint")), ["deck_id"], ["slide_index"])
        .running_sum("run_no", "__break").apply(split)
    )
    sized = with_group_values(
        runs, ["deck_id", "run_no"],
        {"sequence_length": F.count(F.lit(1)), "reference_slide": F.max("slide_index")}, split)
    return sized.where(F.col("sequence_length") >= 2).select(*SLIDE, "run_no", "sequence_length", "reference_slide")


def element_pairs(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Original and translation of each element: a join by element, as one grouping.

    A grouping leaves tables where they are that are partitioned by deck; a join would shuffle both texts.
    """
    key, none = [*SLIDE, "element_id"], F.lit(None).cast("string")
    known = F.col("deck_id").isNotNull() & F.col("slide_index").isNotNull() & F.col("element_id").isNotNull()
    sides = original.select(*key, F.struct(F.col("text").alias("text")).alias("__o"), F.struct(none.alias("text")).alias("__t"), F.lit(True).alias("__first")).unionByName(
        translated.select(*key, F.struct(none.alias("text")).alias("__o"), F.struct(F.col("text").alias("text")).alias("__t"), F.lit(False).alias("__first")))
    met = sides.where(known).groupBy(*key).agg(
        F.collect_list(F.when(F.col("__first"), F.col("__o"))).alias("__o"), F.collect_list(F.when(~F.col("__first"), F.col("__t"))).alias("__t"))
    each = met.select(*key, F.explode("__o").alias("__o"), "__t").select(*key, "__o", F.explode("__t").alias("__t"))
    return each.select(*key, F.col("__o.text").alias("original"), F.col("__t.text").alias("translated"))


def element_mapping(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Original text to translation per slide, by element; the last element of a text wins."""
    said = element_pairs(original.where(F.trim("text") != ""), translated.where(F.trim("text") != ""))
    return said.groupBy(*SLIDE, norm(F.col("original")).alias("original_norm")).agg(
        F.max_by(F.trim("translated"), F.col("element_id")).alias("translated_text"))


def glossary_intervals(pairs: DataFrame, split: bool | None = None) -> DataFrame:
    """For each original the translation that is valid for later slides, until it is replaced.

    ``pairs``: deck_id, slide_index, element_id, original, translated.  The last
    element of a slide wins; equal pairs say nothing.  A slide sees what slides
    before it wrote, so a pair is valid from the next slide on.
    """
    o, t = F.trim("original"), F.trim("translated")
    last = (
        pairs.where((o != "") & (t != "") & (o != t))
        .groupBy(*SLIDE, o.alias("original")).agg(F.max_by(t, F.col("element_id")).alias("translated"))
    )
    return (
        OrderedScan(last, ["deck_id", "original"], ["slide_index"]).lead("valid_to", "slide_index").apply(split)
        .withColumn("valid_from", F.col("slide_index") + 1).drop("slide_index")
    )


def running_glossary(texts: DataFrame, intervals: DataFrame) -> DataFrame:
    """What the running glossary says about the texts of each slide.

    ``texts``: deck_id, slide_index, original. The intervals of a text do not
    overlap (see ``glossary_intervals``), so a slide sees the last one that
    began, if it has not ended.
    """
    entry = F.struct("translated", "valid_to")
    none = F.lit(None).cast("struct<translated:string,valid_to:bigint>")
    known = F.col("deck_id").isNotNull() & F.col("original").isNotNull()
    own = texts.where(known & F.col("slide_index").isNotNull()).select("*", F.col("slide_index").alias("__at"), none.alias("__entry"), F.lit(1).alias("__asks"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields if f.name not in ("deck_id", "original")]
    begun = intervals.where(known).select(
        "deck_id", "original", F.col("valid_from").alias("__at"), entry.cast("struct<translated:string,valid_to:bigint>").alias("__entry"), F.lit(0).alias("__asks"), *blank)
    w = Window.partitionBy("deck_id", "original").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = own.unionByName(begun).withColumn("__entry", F.last("__entry", ignorenulls=True).over(w)).where("__asks = 1")
    valid = F.col("__entry").isNotNull() & (F.col("__entry.valid_to").isNull() | (F.col("slide_index") <= F.col("__entry.valid_to")))
    return said.where(valid).select(*texts.columns, F.col("__entry.translated").alias("translated"))


def slide_glossary(texts: DataFrame, intervals: DataFrame, sequences: DataFrame, reference: DataFrame) -> DataFrame:
    """Glossary of each slide's texts: the reference mapping inside a sequence, else the running one."""
    placed = looked_up(texts, sequences, SLIDE, ["reference_slide"], "left")
    ref = reference.select("deck_id", F.col("slide_index").alias("reference_slide"), "original_norm", F.col("translated_text").alias("translated"))
    inside = placed.where(F.col("reference_slide").isNotNull()).withColumn("original_norm", norm(F.col("original")))
    fixed = looked_up(inside, ref, ["deck_id", "reference_slide", "original_norm"], ["translated"])
    running = running_glossary(placed.where(F.col("reference_slide").isNull()).drop("reference_slide"), intervals)
    return fixed.select(*SLIDE, "original", "translated", F.lit("reference").alias("origin")).unionByName(
        running.select(*SLIDE, "original", "translated", F.lit("running").alias("origin")))


def leftover_check(translated: DataFrame, sequences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Elements of a sequence's slides that still show the original text.

    The reference slide itself is not checked.  ``mapping`` as from ``element_mapping``.
    """
    member = sequences.where(F.col("slide_index") != F.col("reference_slide"))
    ref = mapping.select("deck_id", F.col("slide_index").alias("reference_slide"), F.col("original_norm").alias("original"),
                         F.col("translated_text").alias("expected"))
    shown = translated.select(*SLIDE, "element_id", norm(F.col("text")).alias("original"), F.trim("text").alias("got")).where(F.col("original") != "")
    placed = looked_up(shown, member, SLIDE, ["run_no", "reference_slide"])
    return (
        looked_up(placed, ref, ["deck_id", "reference_slide", "original"], ["expected"])
        .where(F.col("original") != norm(F.col("expected")))
        .select(*SLIDE, "run_no", "element_id", "original", "expected", "got")
    )


def consistency_report(sequences: DataFrame, issues: DataFrame, decks: DataFrame | None = None) -> DataFrame:
    """Per deck: sequences, slides in them, issues and slides with an issue.

    With ``decks`` (deck_id) every deck has a row, those without a sequence with zeros.
    """
    seq = sequences.groupBy("deck_id").agg(
        F.count_distinct("run_no").alias("sequences_found"), F.count(F.lit(1)).alias("slides_in_sequences"))
    bad = issues.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("inconsistencies_found"), F.count_distinct("slide_index").alias("slides_with_issue"))
    zero = F.lit(0).cast("bigint")
    if decks is not None:
        seq = decks.select("deck_id").distinct().join(seq, "deck_id", "left")
    return seq.join(bad, "deck_id", "left").select(
        "deck_id", F.coalesce("sequences_found", zero).alias("sequences_found"), F.coalesce("slides_in_sequences", zero).alias("slides_in_sequences"), F.coalesce("inconsistencies_found", zero).alias("inconsistencies_found"),
        F.coalesce("slides_with_issue", zero).alias("slides_with_issue"))


def first_issues(issues: DataFrame) -> DataFrame:
    """The issue that is reported for a slide: its first element."""
    text = F.concat(F.lit("'"), F.col("original"), F.lit("' expected '"), F.col("expected"), F.lit("' but got '"), F.col("got"), F.lit("'"))
    return issues.groupBy(*SLIDE).agg(F.min_by(text, F.struct("element_id", "original")).alias("description"))


def distinct_pairs(mapping: DataFrame, sequences: DataFrame) -> DataFrame:
    """Distinct reference pairs, with the slide where each was first seen."""
    refs = sequences.select("deck_id", F.col("reference_slide").alias("slide_index")).distinct()
    return (
        looked_up(mapping, refs, SLIDE, []).groupBy("deck_id", F.col("original_norm").alias("source"), F.col("translated_text").alias("target"))
        .agg(F.min("slide_index").alias("first_slide"))
    )
