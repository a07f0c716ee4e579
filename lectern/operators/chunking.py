"""Greedy chunks without a loop over rows: next pointers and doubling.

A chunk that starts at a row ends before the first row that overflows a limit.
Running sizes are monotonic, so where that is can be looked up: the rows whose
running size lies within the start's bound are counted, by one scan over rows
and bounds laid out together by size. Each row then points to the start of the
next chunk, and the chunks of a key are the rows that its first row reaches.
Within a piece of rows the pointers are followed by an array fold in the JVM;
between pieces they are doubled, one join for each doubling of the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scan import OrderedScan
from lectern.settings import has_hot_key, staged

PIECE_ROWS = 512
#: chunks of at most so many rows are looked up in a window frame
FRAME_ROWS = 64


def _looked_up(rows: DataFrame, key: str, limits: dict[str, tuple[int, int]], max_count: int, split: bool | None) -> DataFrame:
    """Adds ``__next``, the number of the row that opens the chunk after one that starts here, by look-ups of running sizes."""
    at, ends = F.col("__at"), None
    for size, (limit, _joint) in limits.items():
        total = F.col(f"__upto_{size}")
        # rows first: a running size equal to the bound is within it
        kinds = F.array(
            F.struct(total.alias("v"), F.lit(0).alias("bound")), F.struct((total + limit - F.col(size)).alias("v"), F.lit(1).alias("bound")))
        laid = rows.select(key, "__at", F.explode(kinds).alias("x")).select(key, "__at", "x.v", "x.bound")
        counted = OrderedScan(laid, [key], ["v", "bound", "__at"]).running_sum("__within", F.when(F.col("bound") == 0, 1).otherwise(0)).apply(split)
        one = counted.where("bound = 1").select(F.col(key).alias("__k"), F.col("__at").alias("__a"), (F.col("__within") + 1).alias("__end"))
        ends = one if ends is None else ends.unionByName(one)
    nearest = ends.groupBy("__k", "__a").agg(F.min("__end").alias("__end"))
    joined = rows.join(nearest, F.col(key).eqNullSafe(F.col("__k")) & (at == F.col("__a"))).drop("__k", "__a")
    return joined.withColumn("__next", F.greatest(at + 1, F.least(at + max_count, F.col("__end")))).drop("__end")


def _in_frame(rows: DataFrame, key: str, limits: dict[str, tuple[int, int]], max_count: int) -> DataFrame:
    """The same where a chunk has few rows: the running sizes of the rows it may have stand in a window frame."""
    at, counts = F.col("__at"), []
    frame = Window.partitionBy(key).orderBy("__at").rowsBetween(0, max_count - 1)
    for size, (limit, _joint) in limits.items():
        bound = F.col(f"__upto_{size}") + limit - F.col(size)
        counts.append((F.collect_list(f"__upto_{size}").over(frame), bound))
    seen = rows.withColumns({f"__frame{i}": c for i, (c, _bound) in enumerate(counts)})

    def within(sizes: str, bound: Column) -> Column:
        return F.size(F.filter(sizes, lambda v: v <= bound))

    inside = [within(f"__frame{i}", bound) for i, (_c, bound) in enumerate(counts)]
    least = F.least(*inside) if len(inside) > 1 else inside[0]
    return seen.withColumn("__next", at + F.greatest(F.lit(1), least)).drop(*[f"__frame{i}" for i in range(len(counts))])


def _leaving(rows: Column, last: Column) -> Column:
    """For each row of a piece the first row behind the piece that its pointers lead to."""
    def step(done: Column, r: Column) -> Column:
        return F.concat(F.array(F.when(r["next"] > last, r["next"]).otherwise(F.get(done, (r["next"] - r["at"] - 1).cast("int")))), done)

    return F.aggregate(F.reverse(rows), F.array().cast("array<bigint>"), step)


def _heads(rows: Column, first: Column) -> Column:
    """Whether each row of a piece is reached by the pointers from ``first``."""
    start = F.struct(first.alias("due"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        hit = F.coalesce(r["at"] == acc["due"], F.lit(False))
        return F.struct(F.when(hit, r["next"]).otherwise(acc["due"]).alias("due"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def greedy_chunks(
    rows: DataFrame, key: str, order: Sequence[str], limits: dict[str, tuple[int, int]], max_count: int, *,
    piece_rows: int = PIECE_ROWS, split: bool | None = None,
) -> DataFrame:
    """``key``, ``order`` and ``chunk_index`` of every row.

    ``limits``: size column -> (limit, joint), where a chunk's size is the sum of
    its rows' sizes and a joint between each two. A row alone may be over a
    limit. Sizes are not negative. Rows without a key are one group.
    """
    order = list(order)
    if split is None:
        split = has_hot_key(rows.select(key), [key])
    scan = OrderedScan(rows.select(key, *order, *limits), [key], order).row_number("__at")
    for size, (_limit, joint) in limits.items():
        scan = scan.running_sum(f"__upto_{size}", F.col(size).cast("bigint") + joint)
    numbered = scan.apply(split)
    max_count = max(1, max_count)
    if split or max_count > FRAME_ROWS:
        pointed = _looked_up(staged(numbered), key, limits, max_count, split)
    else:
        pointed = _in_frame(numbered, key, limits, max_count)
    piece = F.floor((F.col("__at") - 1) / piece_rows).cast("bigint")
    item = F.struct(F.col("__at").alias("at"), F.col("__next").alias("next"), F.struct(*order).alias("order"))
    pieces = staged(pointed.groupBy(key, piece.alias("__piece")).agg(F.array_sort(F.collect_list(item)).alias("__rows")))
    last = pieces.agg(F.max("__piece")).first()[0] or 0
    one = F.lit(1).cast("bigint")
    if last == 0:
        entered = pieces.withColumn("__enter", one)
    else:
        ends = pieces.withColumn("__leave", _leaving(F.col("__rows"), (F.col("__piece") + 1) * piece_rows))
        hops = staged(ends.select(key, F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__leave").alias("to"))).alias("x")).select(
            F.col(key).alias("__k"), F.col("x.r.at").alias("__a"), F.col("x.to").alias("__to")))
        # only rows that some piece is left for can enter one
        entries = hops.select(F.col("__k").alias("__k2"), F.col("__to").alias("__a2")).distinct()
        here = F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__a") == F.col("__a2"))
        first = hops.where("__a = 1")
        jumps = staged(hops.join(entries, here).select("__k", "__a", "__to").unionByName(first).distinct())
        reached = first.select("__k", "__a")
        for _ in range(last.bit_length()):
            far = jumps.select(F.col("__k").alias("__k2"), F.col("__a").alias("__a2"), F.col("__to").alias("__far"))
            moved = reached.join(far, here).select("__k", F.col("__far").alias("__a"))
            reached = staged(reached.unionByName(moved).distinct())
            twice = F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__to") == F.col("__a2"))
            jumps = staged(jumps.join(far, twice).select("__k", "__a", F.col("__far").alias("__to")))
        starts = reached.groupBy("__k", F.floor((F.col("__a") - 1) / piece_rows).cast("bigint").alias("__p")).agg(F.min("__a").alias("__enter"))
        entered = pieces.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__piece") == F.col("__p")), "left").drop("__k", "__p")
    marked = entered.select(key, F.explode(F.arrays_zip(F.col("__rows").alias("r"), _heads(F.col("__rows"), F.col("__enter")).alias("h"))).alias("x")).select(
        key, *[F.col(f"x.r.order.{c}").alias(c) for c in order], F.col("x.r.at").alias("__at"), F.col("x.h").cast("bigint").alias("__head"))
    return OrderedScan(marked, [key], ["__at"]).running_sum("chunk_index", "__head").apply(split).select(key, *order, "chunk_index")
