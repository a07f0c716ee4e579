"""Lenient casts: three readings of a boolean, and numbers with a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def bool_listed(value: Column) -> Column:
    """True only for 1, true, yes, on."""
    return _word(value).isin("1", "true", "yes", "on")


def bool_not_off(value: Column, default: bool) -> Column:
    """True unless empty, 0, false, no, off; the default when null."""
    return F.when(value.isNull(), F.lit(default)).otherwise(
        ~_word(value).isin("", "0", "false", "no", "off")
    )


def bool_strict(value: Column) -> Column:
    """True only for 1, true, yes."""
    return _word(value).isin("1", "true", "yes")


def int_or(value: Column, default: int) -> Column:
    return F.coalesce(F.trim(value).try_cast("bigint"), F.lit(default).cast("bigint"))


def float_or(value: Column, default: float) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(default).cast("double"))
