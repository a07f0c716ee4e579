"""Plans hold at scale: no cross or nested-loop joins, no window over everything."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL

import __spark_entry__ as entry

#: one-row totals joined to a table
ALLOWED_NESTED_LOOP = {"dedupe_backfills"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_plan(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in ALLOWED_NESTED_LOOP:
        assert "BroadcastNestedLoopJoin" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^()]*)", plan):
        assert not spec.strip().startswith("specifiedwindowframe")
    assert "BatchEvalPython" not in plan, "row-at-a-time Python"


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["slide_intervals"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan
    assert "props" not in plan
