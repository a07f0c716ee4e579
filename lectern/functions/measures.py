"""Array distances and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mad(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays, else infinity."""
    n = F.size(a)
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)
    usable = a.isNotNull() & b.isNotNull() & (n == F.size(b)) & (n > 0)
    return F.when(usable, total / n).otherwise(F.lit(float("inf")))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms of the same length."""
    n = F.size(a)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    x = F.transform(a, lambda v: v.cast("double"))
    y = F.transform(b, lambda v: v.cast("double"))
    sx, sy = total(x), total(y)
    sxy = total(F.zip_with(x, y, lambda p, q: p * q))
    sxx = total(F.transform(x, lambda p: p * p))
    syy = total(F.transform(y, lambda p: p * p))
    num = sxy - sx * sy / n
    den = F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
    return F.when(den > 0, num / den).otherwise(F.lit(1.0))


def histogram_similarity(a: Column, b: Column, threshold: float = 0.55) -> tuple[Column, Column]:
    r = correlation(a, b)
    return r >= threshold, F.round(r, 4)


def nearest_percentiles(
    df: DataFrame, keys: list[str], value: str, ratios: dict[str, float]
) -> DataFrame:
    """Percentiles that are always one of the values: index = half-even of (n - 1) * ratio.

    Works on counts per distinct value, combined map-side, so a key costs as
    much as it has distinct values and not as it has rows.
    """
    counts = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    by_value = Window.partitionBy(*keys).orderBy("__v")
    whole = Window.partitionBy(*keys)
    ranked = counts.select(
        *keys, "__v",
        F.sum("__c").over(by_value).alias("__upto"), F.sum("__c").over(whole).alias("__n"),
    )
    aggs = []
    for name, ratio in ratios.items():
        at = F.bround((F.col("__n") - 1) * float(ratio)).cast("bigint")
        aggs.append(F.min(F.when(F.col("__upto") > at, F.col("__v"))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
