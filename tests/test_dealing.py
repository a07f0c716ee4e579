"""Texts are dealt out once: the steps of a job stay where the rows of a key already are."""

from __future__ import annotations

from conftest import SMALL

import __spark_entry__ as entry
from lectern.operators import consistency
from lectern.operators.grouped import looked_up


def test_texts_of_a_deck_are_dealt_out_once(spark):
    """Steps of the consistency job group and join by deck: only whole documents are shuffled, not the lines of their slides."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("job_deck_consistency", "job_slide_glossary", "slide_glossary", "consistency_report", "glossary_distinct", "leftover_check",
                     "first_issues", "element_mapping", "glossary_intervals"):
            plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.splitlines() if "Exchange" in line]
            assert dealt and all("hashpartitioning(doc_id" in line for line in dealt), (name, dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_elements_are_paired_as_by_a_join(spark):
    """Repeated elements meet each other, empty texts count, rows without a key do not."""
    shape = "deck_id bigint, slide_index bigint, element_id bigint, text string"
    o = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "b"), (1, 1, 2, None), (1, 2, 1, "c"), (None, 1, 1, "n"), (1, None, 1, "n")], shape)
    t = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 1, "y"), (1, 1, 2, "z"), (2, 2, 1, "c"), (None, 1, 1, "n"), (1, None, 1, "n")], shape)
    got = sorted(map(tuple, consistency.element_pairs(o, t).collect()), key=str)
    want = o.withColumnRenamed("text", "original").join(t.withColumnRenamed("text", "translated"), ["deck_id", "slide_index", "element_id"])
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == 5


def test_a_value_is_looked_up_as_by_a_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k bigint, v string")
    table = spark.createDataFrame([(1, 10), (3, 30), (None, 40)], "k bigint, n bigint")
    for how in ("inner", "left"):
        got = looked_up(rows, table, ["k"], ["n"], how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table, "k", how).collect()), key=str)


def test_recognised_pages_are_never_shuffled(spark):
    """Words as nested symbols are many times as large as their text: documents are dealt out before they are cut."""
    plan = entry.queries()["flatten_ocr"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(doc_id" not in line] == []
    plan = entry.queries()["group_text_units"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(doc_id" in line and "REPARTITION" not in line]


def test_a_shared_text_is_cleaned_once(spark):
    from lectern.operators.segments import apportion_words

    rows = [(1, 1, " a  b c ", 10, 0), (1, 1, " a  b c ", 20, 10), (1, 2, "", 5, 0)]
    df = spark.createDataFrame(rows, "video_id bigint, segment_id bigint, text string, overlap_ms bigint, bucket_start_ms bigint")
    out = apportion_words(df, "text", "chunk", split=False)
    assert [r.chunk for r in out.orderBy("segment_id", "bucket_start_ms").collect()] == ["a", "b c", ""]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
