"""Arithmetic on boxes given as x, y, w, h columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(prefix + n) for n in "xywh"])

    def floored(self) -> Box:
        one = F.lit(1).cast("bigint")
        return Box(self.x, self.y, F.greatest(one, self.w), F.greatest(one, self.h))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.cast("bigint").alias(prefix + n) for n, c in zip("xywh", (self.x, self.y, self.w, self.h))]


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    h = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0)).cast("bigint")


def outside_ratio(a: Box, roi: Box) -> Column:
    """Share of ``a`` that lies outside ``roi``."""
    return F.lit(1.0) - intersection(a, roi) / a.area


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when((inter == 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def clamp_box(b: Box, image_w: Column, image_h: Column) -> Box:
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    x = F.greatest(zero, F.least(b.x, F.greatest(zero, image_w - 1)))
    y = F.greatest(zero, F.least(b.y, F.greatest(zero, image_h - 1)))
    w, h = F.greatest(one, b.w), F.greatest(one, b.h)
    return Box(
        x, y, F.greatest(x + 1, F.least(image_w, x + w)) - x, F.greatest(y + 1, F.least(image_h, y + h)) - y
    )


def expand(b: Box, image_w: Column, image_h: Column, left, right, up, down) -> Box:
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    x0, y0 = F.greatest(zero, b.x - left), F.greatest(zero, b.y - up)
    x1, y1 = F.least(image_w, b.right + right), F.least(image_h, b.bottom + down)
    return Box(x0, y0, F.greatest(one, x1 - x0), F.greatest(one, y1 - y0))


def inflate(b: Box, image_w: Column, image_h: Column, pad) -> Box:
    c = clamp_box(b, image_w, image_h)
    return expand(c, image_w, image_h, pad, pad, pad, pad)


def clamp_roi(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column):
    """Corners forced into the frame, at least one pixel wide and high."""
    zero = F.lit(0).cast("bigint")
    left = F.greatest(zero, F.least(x0, F.greatest(zero, w - 1)))
    top = F.greatest(zero, F.least(y0, F.greatest(zero, h - 1)))
    return left, top, F.greatest(left + 1, F.least(x1, w)), F.greatest(top + 1, F.least(y1, h))


def inner_roi(x0: Column, y0: Column, x1: Column, y1: Column):
    """Corners without a 10 % / 8 % rim; the whole region when nothing would be left."""
    dx = F.bround((x1 - x0) * 0.10).cast("bigint")
    dy = F.bround((y1 - y0) * 0.08).cast("bigint")
    fits = (x1 - dx > x0 + dx) & (y1 - dy > y0 + dy)
    return tuple(
        F.when(fits, inner).otherwise(outer)
        for inner, outer in ((x0 + dx, x0), (y0 + dy, y0), (x1 - dx, x1), (y1 - dy, y1))
    )


def intersects(a: Box, b: Box, margin: int = 0) -> Column:
    """Whether two boxes, each grown by ``margin``, share an area."""
    a, b, m = a.floored(), b.floored(), 2 * max(0, margin)
    return (
        (a.x < b.right + m) & (b.x < a.right + m) & (a.y < b.bottom + m) & (b.y < a.bottom + m)
    )


def box_union(df: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around the boxes of each key; sides count as at least 1."""
    b = Box.of().floored()
    one = F.lit(1).cast("bigint")
    return (
        df.groupBy(*keys)
        .agg(F.min(b.x).alias("x"), F.min(b.y).alias("y"),
             F.max(b.right).alias("__r"), F.max(b.bottom).alias("__b"))
        .select(*keys, "x", "y", F.greatest(one, F.col("__r") - F.col("x")).alias("w"),
                F.greatest(one, F.col("__b") - F.col("y")).alias("h"))
    )
