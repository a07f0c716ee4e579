"""Deck glossaries: candidates, lookup, application, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.boxes import Box, intersects
from lectern.functions.scores import font_default, hex_rgb, is_noise
from lectern.functions.text import alnum_only, has_alnum, norm_slide
from lectern.operators.folding import fold_columns
from lectern.operators.grouped import with_group_values
from lectern.operators.stacking import ENTRY_RULE, StackSweep

_CELL = 256


def first_glossary(entries: DataFrame, order: str) -> DataFrame:
    """First usable entry per normalized text."""
    target = F.trim(F.coalesce("target_text", F.lit("")))
    return (
        entries.withColumns({"source_text_norm": norm_slide(F.col("source_text_norm")), "target_text": target})
        .where((F.col("source_text_norm") != "") & (F.col("target_text") != ""))
        .groupBy("source_text_norm").agg(F.min_by("target_text", F.col(order)).alias("target_text"))
    )


def glossary_candidates(units: DataFrame, keys: list[str], order: list[str], examples: int = 5) -> DataFrame:
    """Distinct translatable texts of a deck with where they occur.

    ``units``: keys, role, source_text, slide_index, event_id, image_name,
    line_count, list_marker.  Occurrences are first combined per raw text, so
    a text repeated on every slide does not travel row by row; of its spellings
    only the first few reach the final step.
    """
    texts = (
        units.where(F.col("role") != "graphic_embedded")
        .withColumns({"source_text_norm": norm_slide(F.col("source_text")), "__raw": F.trim("source_text")})
        .where((F.col("source_text_norm") != "") & has_alnum(F.col("source_text_norm")))
    )
    at = F.struct(*order)
    by = [*keys, "source_text_norm"]
    raw = texts.groupBy(*by, "__raw").agg(
        F.min(at).alias("__at"), F.count(F.lit(1)).alias("__n"), F.max("line_count").alias("__lines"),
        F.count_if("list_marker").alias("__markers"),
        F.collect_set("slide_index").alias("__slides"), F.collect_set("event_id").alias("__events"),
        F.collect_set("image_name").alias("__images"),
    )
    w = Window.partitionBy(*by).orderBy("__at")
    ranked = raw.withColumn("__k", F.row_number().over(w))
    shown = F.when(F.col("__k") <= examples, F.struct("__k", "__raw"))

    def ids(column: str, keep) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(column)), keep)))

    # the window and the sums share one shuffle by text
    counts = ranked.groupBy(*by).agg(
        F.sum("__n").alias("occurrences"), F.array_sort(F.collect_list(shown)).alias("__ex"),
        ids("__slides", lambda v: v > 0).alias("slide_indices"), ids("__events", lambda v: v > 0).alias("event_ids"),
        ids("__images", lambda v: v != "").alias("image_names"),
        F.max("__lines").alias("max_line_count"), F.sum("__markers").alias("list_marker_occurrences"),
    )
    return counts.select(
        *by, F.col("__ex")[0]["__raw"].alias("source_text"), "occurrences", "slide_indices", "event_ids", "image_names",
        F.transform("__ex", lambda e: e["__raw"]).alias("source_examples"), "max_line_count", "list_marker_occurrences",
    )


def glossary_occurrences(units: DataFrame, keys: list[str]) -> DataFrame:
    """Where each text occurs, as one row per text and slide."""
    return (
        units.where(F.col("role") != "graphic_embedded")
        .withColumn("source_text_norm", norm_slide(F.col("source_text")))
        .where((F.col("source_text_norm") != "") & has_alnum(F.col("source_text_norm")))
        .groupBy(*keys, "source_text_norm", "slide_index").agg(F.count(F.lit(1)).alias("occurrences"))
    )


def drop_noise(units: DataFrame) -> DataFrame:
    """Units worth translating: not in a graphic, not an artefact, with letters or digits."""
    alnum = F.length(alnum_only(F.col("source_text")))
    noise = is_noise(F.col("role"), F.col("list_marker"), alnum, F.greatest(F.lit(1), F.col("w")) * F.greatest(F.lit(1), F.col("h")))
    # one element, so that a text is normalized once and not wherever the filter names it
    normed = units.where((F.col("role") != "graphic_embedded") & ~noise).withColumn(
        "source_text_norm", F.explode(F.array(norm_slide(F.col("source_text")))))
    # a text with a letter or digit is not empty
    return normed.where(has_alnum(F.col("source_text_norm")))


def apply_glossary(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """Outcome of each unit: resolved, identical, missing_glossary_match or empty_target_text.

    What becomes of a text is decided by its entry alone, once an entry and not once a unit.
    """
    target = F.trim(F.coalesce("target_text", F.lit("")))
    found = (
        F.when(target == "", "empty_target_text")
        .when(norm_slide(target) == F.col("source_text_norm"), "identical").otherwise("resolved")
    )
    g = glossary.select("source_text_norm", target.alias("target_text"), found.alias("outcome"))
    joined = units.join(g, "source_text_norm", "left")
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit("missing_glossary_match")))


def slide_output_status(outcomes: DataFrame, keys: list[str], policy: str = "partial") -> DataFrame:
    """Status of each slide from the outcomes of its units."""
    unresolved = F.col("outcome").isin("missing_glossary_match", "empty_target_text")
    g = outcomes.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "resolved").alias("rendered_fragments"),
        F.count_if(unresolved).alias("unresolved_fragments"),
        F.count_if(F.col("outcome") == "identical").alias("identical_fragments"),
    )
    review = F.col("unresolved_fragments") > 0
    status = (
        F.when(review & F.lit(policy == "mark_only"), "needs_review_unmodified")
        .when(F.col("rendered_fragments") > 0, F.when(review, "needs_review_partial").otherwise("translated"))
        .when(review, "needs_review_unmodified").otherwise("unchanged")
    )
    return g.withColumn("status", status).withColumn("needs_review", review)


def _celled(boxes: DataFrame, margin: int) -> DataFrame:
    b, one = Box.of().floored(), F.lit(1)

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(F.floor((low - margin) / _CELL), F.floor((high + margin - one) / _CELL))

    return boxes.withColumn("__cx", F.explode(cells(b.x, b.right))).withColumn("__cy", F.explode(cells(b.y, b.bottom)))


def box_collisions(boxes: DataFrame, blocked: DataFrame, keys: list[str], box_id: str, margin: int = 2) -> DataFrame:
    """Whether each box touches a blocked box of the same slide other than itself.

    Boxes meet only inside shared cells and by a semi join, so no pairs are produced.
    """
    a = _celled(boxes, margin)
    names = ["x", "y", "w", "h", box_id]
    b = _celled(blocked, margin).select(*keys, "__cx", "__cy", *[F.col(n).alias(f"b_{n}") for n in names])
    left, right = Box.of(), Box.of("b_")
    cond = [a[k] == b[k] for k in [*keys, "__cx", "__cy"]]
    cond.append(F.col(box_id) != F.col(f"b_{box_id}"))
    cond.append(intersects(left, right, margin))
    hit = a.join(b, cond, "left_semi").select(*keys, box_id).distinct().withColumn("__hit", F.lit(True))
    return boxes.join(hit, [*keys, box_id], "left").withColumn("collides", F.coalesce("__hit", F.lit(False))).drop("__hit")


def resolve_style(units: DataFrame, styles: DataFrame, names: dict[str, str]) -> DataFrame:
    """Style values of each unit: slot over role over default.

    ``styles(level, key, name, value)`` with level default/role/slot; ``names``
    maps a wanted name to its default.  The table is turned into one map per key
    first; how it is joined is left to Spark's own size check, and the defaults are a scalar.
    """
    m = F.map_from_entries(F.collect_list(F.struct("name", "value")))

    def level(lv: str, key: str) -> DataFrame:
        return styles.where(F.col("level") == lv).groupBy(F.col("key").alias(key)).agg(m.alias(f"__{lv}"))

    # an aggregate without keys is one value, whatever the table
    base = styles.where(F.col("level") == "default").agg(m.alias("__default")).scalar()
    out = units.join(level("slot", "slot_id"), "slot_id", "left").join(level("role", "role"), "role", "left").withColumn("__default", base)
    for name, default in names.items():
        at = [F.try_element_at(f"__{lv}", F.lit(name)) for lv in ("slot", "role", "default")]
        out = out.withColumn(name, F.coalesce(*at, F.lit(default)))
    return out.drop("__slot", "__role", "__default")


def font_sizes(styled: DataFrame, cap: int) -> DataFrame:
    """Font size and its lower bound within the caps."""
    wanted = F.coalesce(F.col("font_size").try_cast("bigint"), font_default(F.col("h"), F.col("line_count")))
    size = F.least(F.greatest(F.lit(8), wanted), F.lit(max(8, cap))).cast("bigint")
    fixed = F.lower(F.trim(F.coalesce("font_size_mode", F.lit("fixed")))) != "fit"
    low = F.greatest(F.lit(8), F.least(size, F.coalesce(F.col("min_font_size").try_cast("bigint"), size)))
    return styled.withColumns({"font_size": size, "min_font_size": F.when(fixed, size).otherwise(low).cast("bigint")})


def style_metrics(entries: DataFrame, keys: list[str], split: bool | None = None) -> DataFrame:
    """Text colour per unit: fixed, its own, or the median of its slot, role or itself.

    Medians are over channel values 0-255, so their combined counts stay small
    however often a role occurs.
    """
    out = entries
    for level in ("slot_id", "role"):
        out = with_group_values(
            out, [*keys, level],
            {f"__{level}_{ch}": F.median(ch) for ch in ("r", "g", "b")}, split)
    fixed = hex_rgb(F.col("text_color"))
    own = F.array("r", "g", "b")
    by_slot = F.array(*[
        F.bround(F.coalesce(f"__slot_id_{c}", f"__role_{c}", c)).cast("bigint") for c in ("r", "g", "b")])
    mode = F.lower(F.trim(F.coalesce("text_color_mode", F.lit("source_median"))))
    rgb = F.when((mode == "fixed") & fixed.isNotNull(), fixed).when(mode == "source_entry", own).otherwise(by_slot)
    drop = [f"__{lv}_{c}" for lv in ("slot_id", "role") for c in ("r", "g", "b")]
    return out.withColumn("text_color_rgb", rgb).drop(*drop)


class _Entries:
    """Stacks of the entries of one slide."""

    def __init__(self) -> None:
        self.sweep = StackSweep(ENTRY_RULE)

    def __call__(self, x, y, w, h, tallest):
        return (self.sweep.place(x, y, w, h, 0, tallest),)


def stacked_groups(entries: DataFrame, split: bool | None = None) -> DataFrame:
    """Groups of at least two stacked entries per slide."""
    one = F.lit(1).cast("bigint")
    rows = entries.select("slide_id", "unit_id", "x", "y", F.greatest(one, F.col("w")).alias("w"),
                          F.greatest(one, F.col("h")).alias("h"))
    rows = rows.withColumn("__tallest", F.max("h").over(Window.partitionBy("slide_id")))
    grouped = fold_columns(
        rows, ["slide_id"], ["y", "x", "unit_id"], _Entries, ["x", "y", "w", "h", "__tallest"], {"group_no": "bigint"}).drop("__tallest")
    sized = with_group_values(grouped, ["slide_id", "group_no"], {"group_size": F.count(F.lit(1))}, split)
    return sized.where(F.col("group_size") >= 2).select("slide_id", "unit_id", "group_no", "group_size")
