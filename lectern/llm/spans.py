"""Where a pattern matches, as DataFrame expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def match_spans(text: Column, pattern: Column, measure=F.length) -> Column:
    """Start and end of every leftmost non-overlapping match, with the matched text.

    The text between matches and the matches themselves are measured and added
    up, so positions are in whatever ``measure`` counts (code points by
    default). No match: an empty array. Null text: null.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)), hits,
        lambda gap, hit: F.struct(
            measure(gap).cast("bigint").alias("gap"), measure(hit).cast("bigint").alias("len"), hit.alias("hit")
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def constant_table(rows: list[dict], schema: str) -> Column:
    """A small fixed table as one array value, folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def comma_joined(values: Column) -> Column:
    return F.coalesce(F.array_join(values, ","), F.lit(""))


def finished(df: DataFrame, columns: list[str], result: Column, name: str) -> DataFrame:
    """The columns of the struct ``row`` and a result, worked out once.

    An exploded array of one row, like in ``rows_where``: filters on the result
    stay above it. A given column with the name of the result is replaced.
    """
    one = F.struct(*[F.col("row")[c].alias(c) for c in columns if c != name], result.alias(name))
    return df.select(F.explode(F.array(one)).alias("row")).select("row.*")


def rows_where(df: DataFrame, flag: Column, columns: list[str]) -> DataFrame:
    """These columns of the rows that meet ``flag``.

    An exploded array of one row or none: unlike a filter it is not pushed
    below the projections that work the flag out, which would repeat them.
    """
    one = F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]))
    return df.select(F.explode(F.when(flag, one)).alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])
