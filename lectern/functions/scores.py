"""Scores and zones of text units on a slide.

The thresholds and weights are fixed values of the slide model; sums keep their
order, so that borderline scores come out the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(value: Column, steps: list[tuple[float, float]], otherwise: float, strict: bool = False) -> Column:
    """First weight whose limit is not exceeded (or stays strictly above the value)."""
    out = None
    for limit, weight in steps:
        cond = value < limit if strict else value <= limit
        out = F.when(cond, F.lit(weight)) if out is None else out.when(cond, F.lit(weight))
    return out.otherwise(F.lit(otherwise))


def heading_score(words, lines, height, top, width, median_h, p75_h) -> Column:
    by_words = _steps(words, [(8, 0.9), (14, 0.6), (20, 0.2), (28, -0.4)], -1.0)
    by_lines = _steps(lines, [(1, 0.7), (2, 0.5), (3, 0.1)], -0.8)
    one = F.lit(1.0)
    rm, rp = height / F.greatest(one, median_h), height / F.greatest(one, p75_h)
    by_height = (
        F.when((rm >= 1.25) | (rp >= 1.05), 1.3).when((rm >= 1.12) | (rp >= 0.95), 0.9)
        .when(rm >= 1.0, 0.45).when(rm >= 0.9, 0.05).otherwise(-0.7)
    )
    by_top = _steps(top, [(0.24, 0.8), (0.45, 0.55), (0.62, 0.25), (0.78, -0.15)], -0.7, strict=True)
    by_width = _steps(width, [(0.78, 0.25), (0.92, 0.1)], -0.15)
    return by_words + by_lines + by_height + by_top + by_width


def graphic_score(std_gray, edge_density, sat_std, luma_range) -> Column:
    """How busy the surroundings of a text are."""
    def level(v, high, w_high, low, w_low):
        return F.when(v >= high, F.lit(w_high)).when(v >= low, F.lit(w_low)).otherwise(F.lit(0.0))

    return (
        level(std_gray, 22.0, 1.2, 16.0, 0.5) + level(edge_density, 0.06, 1.2, 0.04, 0.5)
        + level(sat_std, 20.0, 1.0, 14.0, 0.4) + level(luma_range, 56.0, 0.9, 40.0, 0.35)
    )


def is_graphic(score, words, lines, width, top) -> Column:
    return (score >= 2.95) & (words > 0) & (words <= 10) & (lines <= 3) & (width <= 0.68) & (top >= 0.12)


def horizontal_zone(center: Column) -> Column:
    return F.when(center < 0.34, "left").when(center > 0.66, "right").otherwise("center")


def vertical_zone(center: Column) -> Column:
    return (
        F.when(center < 0.18, "top").when(center < 0.38, "upper").when(center < 0.68, "middle")
        .when(center < 0.88, "lower").otherwise("bottom")
    )


def slot_id(role: Column, vertical: Column, horizontal: Column) -> Column:
    listed = role.startswith("list_item_")
    return F.when(listed, F.concat(role, F.lit("."), horizontal)).otherwise(
        F.concat(role, F.lit("."), vertical, F.lit("_"), horizontal))


def font_default(height: Column, lines: Column) -> Column:
    return F.greatest(F.lit(8), F.bround(height / F.greatest(F.lit(1), lines) * 0.72)).cast("bigint")


def hex_rgb(color: Column) -> Column:
    """``#1a2b3c`` -> [26, 43, 60]; null for automatic or malformed colours."""
    digits = F.regexp_replace(F.trim(F.coalesce(color, F.lit(""))), "^#", "")
    part = [F.conv(F.substring(digits, p, 2), 16, 10).cast("bigint") for p in (1, 3, 5)]
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.array(*part))


def padding_shorthand(value: Column) -> Column:
    """One to four numbers to [top, right, bottom, left]; null when malformed."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[,\s]+", " ")), " ")
    v = F.transform(parts, lambda p: p.try_cast("double"))
    n = F.size(v)

    def pick(*at: int) -> Column:
        return F.array(*[F.try_element_at(v, F.lit(a)) for a in at])

    sides = (
        F.when(n == 1, pick(1, 1, 1, 1)).when(n == 2, pick(1, 2, 1, 2)).when(n == 3, pick(1, 2, 3, 2))
        .when(n == 4, pick(1, 2, 3, 4))
    )
    return F.when(~F.exists(v, lambda x: x.isNull()), sides)


def is_noise(role: Column, marker: Column, alnum: Column, area: Column) -> Column:
    """A tiny box with next to no letters; headings and list items are never noise."""
    exempt = role.isin("title", "subtitle", "section_heading", "list_item_level_1", "list_item_level_2") | marker
    # the area first: the letters of a box that is not tiny are never counted
    tiny = ((area <= 700) & (alnum == 0)) | ((area <= 1200) & (alnum <= 1)) | ((area <= 350) & (alnum <= 2))
    return ~exempt & tiny
