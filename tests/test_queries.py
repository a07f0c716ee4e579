"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import check
import pytest
from conftest import SMALL

import __spark_entry__ as entry

SQL = entry.oracle_sql()
TESTS = Path(__file__).parent
#: queries that SQL cannot express, with the test that holds them or all their parts against a plain loop
LOOPS = {
    "stitch_overlaps": ["test_stitch"], "group_text_units": ["test_group_fragments_uses_markers_and_gaps"], "implicit_lists": ["test_implicit_lists"],
    "stacked_groups": ["test_stacked_groups"], "match_phrases": ["test_match_phrases"], "classify_units": ["test_implicit_lists"],
}


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note, _took = check.compare(spark, con, SMALL, name, entry.queries()[name], SQL.get(name))
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_without_sql_names_its_loop(name):
    text = "".join(p.read_text() for p in TESTS.rglob("test_*.py") if p.name != "test_queries.py")
    if name in LOOPS:
        assert all(f"def {test}(" in text for test in LOOPS[name])
    else:
        # corpus queries are run by name in their own tests
        assert f'"{name}"' in text or name == "pipeline" and "corpus_pipeline.run" in text, name


def test_entry(spark):
    df = entry.entry(spark)
    assert "bucket_id" in df.columns and df.count() > 0


def test_oracle_names():
    assert set(SQL) <= set(entry.queries())
