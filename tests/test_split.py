"""Results do not depend on whether a key is treated as hot, nor on the number of partitions."""

from __future__ import annotations

import check
import pytest
from conftest import SMALL

import __spark_entry__ as entry

NAMES = [
    "slide_text_map", "fill_buckets", "apportion_words", "slide_changes", "final_slides", "project_time", "snap_nearest",
    "timeline_master", "timeline_segmented", "slot_ids", "promote_headings", "build_sequences", "glossary_intervals", "allocate_words",
    "align_by_words", "number_batches", "step_state", "suppress_repeats", "longest_stable_run", "style_metrics", "chunk_timeline",
]


def rows(spark, name):
    df = entry.queries()[name](spark, SMALL)
    return check.rows_of(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_give_the_same_rows(spark, name):
    plain = rows(spark, name)
    spark.conf.set("lectern.maxGroupRows", "3")
    try:
        assert rows(spark, name) == plain
    finally:
        spark.conf.unset("lectern.maxGroupRows")


@pytest.mark.parametrize("name", ["slide_text_map", "final_slides"])
def test_partition_count(spark, name):
    plain = rows(spark, name)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(spark, name) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_without_a_key_form_one_group_on_both_paths(spark):
    from pyspark.sql import functions as F

    from lectern.operators.grouped import with_group_values
    from lectern.operators.scan import OrderedScan

    df = spark.range(20).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("at"), F.lit(1).alias("v"))
    ends, totals = [], []
    spark.conf.set("lectern.maxGroupRows", "3")
    try:
        for split in (False, True):
            ends.append(OrderedScan(df, ["k"], ["at"]).running_sum("run", "v").apply(split).agg(F.max("run")).first()[0])
            totals.append(with_group_values(df, ["k"], {"all": F.sum("v")}, split).select("all").distinct().collect())
    finally:
        spark.conf.unset("lectern.maxGroupRows")
    assert ends == [20, 20]
    assert [[r[0] for r in t] for t in totals] == [[20], [20]]
