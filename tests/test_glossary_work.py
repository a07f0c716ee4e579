"""Texts of units are normalized once, and what becomes of a text is decided once an entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import word_count
from lectern.operators import glossary

UNITS = "slide_id bigint, unit_id bigint, role string, list_marker boolean, source_text string, w bigint, h bigint"


def _units(spark):
    texts = ["Ein  Text", "same text", "none", "blank", "null", "’", "", None, "Ä  b", "x"]
    rows = [(1, i, "body", False, text, 5 if text == "x" else 100, 20) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, UNITS)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_units_are_normalized_once(spark):
    kept = glossary.drop_noise(_units(spark))
    plan = _plan(kept)
    assert plan.count("(?U)\\s+") == 1 and plan.count("ArrowEvalPython") == 1
    assert sorted(r.source_text_norm for r in kept.collect()) == ["Ein Text", "blank", "none", "null", "same text", "Ä b"]


def test_an_entry_decides_what_becomes_of_its_text(spark):
    entries = spark.createDataFrame(
        [("Ein Text", " A text "), ("same text", " same   text"), ("blank", "  "), ("null", None), ("Ä b", "Ä b"), ("unused", "u")],
        "source_text_norm string, target_text string")
    out = glossary.apply_glossary(glossary.drop_noise(_units(spark)), entries)
    got = {r.source_text_norm: (r.target_text, r.outcome) for r in out.collect()}
    assert got == {
        "Ein Text": ("A text", "resolved"), "same text": ("same   text", "identical"), "none": (None, "missing_glossary_match"),
        "blank": ("", "empty_target_text"), "null": ("", "empty_target_text"), "Ä b": ("Ä b", "identical")}
    join = _plan(out).index("Join LeftOuter")
    assert "ArrowEvalPython" not in _plan(out)[:join]


def test_words_are_counted_from_one_normalized_text(spark):
    df = spark.createDataFrame([("",), (None,), ("   ",), ("a",), (" a \t b c ",)], "t string")
    counted = df.select(word_count(F.col("t")).alias("n"))
    assert [r.n for r in counted.collect()] == [0, 0, 0, 1, 3]
    assert _plan(counted).count("(?U)\\s+") == 1
