"""Text units of a slide: fragments are read once, markers and lines meet as in a plain loop."""

from __future__ import annotations

import random
import sys
import unicodedata

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import text
from lectern.operators import ocr


def test_fragments_are_cut_once(spark):
    """The nested pages are unfolded by one plan, and lines are shuffled for their numbers and for their units only."""
    plan = entry.queries()["group_text_units"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode(block") == 1 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(slide_id") == 2
    # lines are put together as texts, not as nested symbols
    assert not [line for line in plan.splitlines() if "collect_list" in line and "symbols" in line]


def _units(rows):
    """Unit and marker of each line: the loop over one slide that looks at all its markers."""
    marks = [r for r in rows if r["text_norm"] in text.LIST_MARKERS]
    lines = sorted((r for r in rows if any(c.isalnum() for c in r["text_norm"])), key=lambda r: (r["y"], r["x"], r["fragment_id"]))
    out, taken, unit, marker, left, width, above = {}, set(), 0, 0, 0, 0, None
    for r in lines:
        x, y, w, h = r["x"], r["y"], max(1, r["w"]), max(1, r["h"])
        found = []
        for m in marks:
            mw, mh = max(1, m["w"]), max(1, m["h"])
            tall, gap = max(h, mh), x - m["x"] - mw
            level, top = abs(y + h / 2.0 - (m["y"] + mh / 2.0)), abs(y - m["y"])
            if -8 <= gap <= max(80, round(h * 3.2)) and level <= max(18.0, tall * 0.9) and top <= max(28, round(tall * 1.4)) and m["fragment_id"] not in taken:
                found.append((level + max(0, gap) * 0.15 + top * 0.1, m["y"], m["x"], m["fragment_id"]))
        own, near = min(found)[3] if found else 0, False
        tall = max(h, above["h"]) if above else h
        if above:
            gap, same = y - above["y"] - above["h"], r["block_id"] == above["block_id"]
            near = gap <= max(32, round(tall * 1.15)) and (same or gap <= max(18, round(tall * 0.55)))
            near = near and (not marker or same or gap <= max(18, round(h * 0.6)))
        if own or not (near and abs(x - left) <= max(26, round(tall * 0.95)) and 0.28 * width <= w <= 3.2 * width):
            unit, marker, left, width = unit + 1, own, x, w
            taken.add(own)
        out[r["slide_id"], r["fragment_id"]], above = (unit, marker), {**r, "h": h}
    return out


def test_markers_and_lines_meet_as_in_a_loop(spark):
    rnd, rows = random.Random(6), []
    for slide in range(60):
        for no in range(1, rnd.randrange(2, 60)):
            marker = rnd.random() < 0.35
            h = rnd.choice([0, 12, 20, 31, 90 if slide % 3 else 700])
            rows.append((slide, no, rnd.randrange(1, 5), rnd.choice(["•", "–", "*"]) if marker else rnd.choice(["word", "two words", "...", ""]),
                         rnd.randrange(0, 120), rnd.randrange(-50, 600), rnd.choice([0, 10, 14]) if marker else rnd.randrange(20, 300), h))
    shape = "slide_id bigint, fragment_id bigint, block_id bigint, text_norm string, x bigint, y bigint, w bigint, h bigint"
    df = spark.createDataFrame(rows, shape).repartition(5)
    got = {(r.slide_id, r.fragment_id): (r.unit_id, r.list_marker_fragment_id) for r in ocr.group_fragments(df).collect()}
    want, named = {}, [dict(zip(df.columns, r)) for r in rows]
    for slide in range(60):
        want.update(_units([r for r in named if r["slide_id"] == slide]))
    assert got == want and sum(m > 0 for _, m in want.values()) > 50


def test_fragments_without_a_slide_or_place(spark):
    shape = "slide_id bigint, fragment_id bigint, block_id bigint, text_norm string, x bigint, y bigint, w bigint, h bigint"
    rows = [(None, 1, 1, "gone", 0, 0, 9, 9), (1, 1, 1, "*", None, 5, 9, 9), (1, 2, 1, "*", 0, None, 9, 9), (1, 3, 1, "a", 12, 5, 9, 9), (1, 4, 1, None, 0, 5, 9, 9)]
    got = ocr.group_fragments(spark.createDataFrame(rows, shape)).collect()
    assert [(r.fragment_id, r.unit_id, r.list_marker_fragment_id) for r in got] == [(3, 1, 0)]


def test_list_markers_are_known_in_any_form(spark):
    """The same as by the key of a slide text, for each character alone and beside others."""
    forms = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = [(c,) for c in forms if len(unicodedata.normalize("NFKC", c)) != 1 or c in text.LIST_MARKERS or unicodedata.normalize("NFKC", c) != c]
    rows += [(f"{a}{b}{c}",) for a in ("", " ", "　", "*", "́") for b in "•﹣－*x⑴" for c in ("", "\t\xa0", " ", "•", "́")] + [("",), (None,), ("\x1c-",)]
    df = spark.createDataFrame(rows, "t string")
    key = text.norm_slide(F.col("t"))
    by_key = key.isin(text.LIST_MARKERS) & ~text.has_alnum(key)
    assert df.where(~text.is_list_marker(F.col("t")).eqNullSafe(by_key)).collect() == []
    assert df.where(text.is_list_marker(F.col("t"))).count() > 40


def test_words_and_the_ends_of_texts(spark):
    """Missing symbols, texts and breaks count as nothing; a break after nothing is dropped; all white space goes at the ends."""
    words = [[("a", None), ("b", "SPACE")], [(None, "SPACE")], None, [("c ", "HYPHEN")], [], [("d", "no such"), (None, "LINE_BREAK")], [("　\x85", "SPACE")]]
    par = (0.5, [(1, 2)], [(w,) for w in words])
    df = spark.createDataFrame([(1, 1, [(9, 9, [([par],)])])], f"slide_id bigint, event_id bigint, pages {ocr.PAGES}")
    assert [(r.text_raw, r.fragment_id) for r in ocr.flatten_ocr(df, False).collect()] == [("ab c -d", 1)]
