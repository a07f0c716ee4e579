"""Ordered folds that are cut into pieces, for keys of any size.

The decision about a row depends on the last row that was kept, so a fold looks
sequential. But its state is only a few references to earlier rows. Every piece
of a key is therefore folded at once, on the guess that it is entered with the
state in which the piece before it ends when that one is entered with nothing.
What is exchanged between pieces are the values those references stand for,
and the table (piece, entering state, leaving state); values of a piece's other
rows never leave it. The table is followed from the first piece of each key. As
long as a chain meets a state that a piece was not folded with, that piece is
folded once more; a state that went through a piece unchanged is tried on twice
as many of the following pieces each time, so a key whose rows are all alike
takes log2(pieces) rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scan import OrderedScan
from lectern.settings import staged

PIECE_ROWS = 4096
_SLOT = pa.struct([("at", pa.int64()), ("value", pa.list_(pa.float64()))])


def _same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _vectors(values: pa.ListArray) -> list[np.ndarray | None]:
    """Views of the rows of a list array; null rows give None.

    ``values.values`` are those of the whole batch, whatever part of it the array is; only its own are converted.
    """
    offsets = values.offsets.to_numpy()
    low, high = (offsets[0], offsets[-1]) if len(offsets) else (0, 0)
    flat = values.values.slice(low, high - low).to_numpy(zero_copy_only=False).astype("float64", copy=False)
    offsets = offsets - low
    return [flat[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], values.is_valid().to_pylist())]


def _fold_pieces(step: Callable, width: int, names: list[str]):
    """Folds every row of a batch, one piece each: its leaving state and the result of each of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaving, results = [], []
            rows, entry = batch.column(batch.schema.names.index("__rows")), batch.column(batch.schema.names.index("__entry"))
            for i in range(batch.num_rows):
                own = rows[i].values
                vectors = _vectors(own.field("value"))
                state = [
                    None if s["at"] < 0 else (s["at"], None if s["value"] is None else np.asarray(s["value"], dtype="float64"))
                    for s in entry[i].as_py()
                ]
                out = []
                for at, flags, vector in zip(own.field("at").to_pylist(), own.field("flags").to_pylist(), vectors):
                    state, result = step(state, at, flags, vector)
                    out.append(result)
                results.append(out)
                leaving.append([{"at": -1, "value": None} if s is None else {"at": s[0], "value": None if s[1] is None else s[1].tolist()} for s in state])
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(leaving, pa.list_(_SLOT)), pa.array(results, pa.list_(pa.int64()))],
                names=[*names, "__leaving", "__results"])

    return run


def _fold_whole(step: Callable, width: int, names: list[str], flags: list[str], value: str, result: str):
    """Folds the sorted rows of whole keys; the row numbered 1 starts a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None] * width
        for batch in batches:
            columns, out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}, []
            flag_rows = zip(*[columns[f].to_pylist() for f in flags]) if flags else [()] * batch.num_rows
            for at, row_flags, vector in zip(columns["__at"].to_pylist(), flag_rows, _vectors(columns[value])):
                if at == 1:
                    state = [None] * width
                state, done = step(state, at, row_flags, vector)
                out.append(done)
            # the last values are views of the whole batch
            state = [s if s is None or s[1] is None else (s[0], s[1].copy()) for s in state]
            yield pa.RecordBatch.from_arrays([*[columns[n] for n in names], pa.array(out, pa.int64())], names=[*names, result])

    return run


def _followed(keys: list[str], kinds: str):
    """Follows the table of one key; rows are (piece, entering, leaving) numbers, one or a few for each piece."""
    fields = [k.split(" ")[0].strip("`") for k in kinds.split(", ")]

    def run(_key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        known = {(int(p), tuple(e)): tuple(x) for p, e, x in zip(table["__piece"], table["__enters"], table["__leaves"])}
        pieces, state, through, out = int(table["__pieces"].iloc[0]), None, 0, []
        for piece in range(pieces):
            entering = state if state is not None else next(e for p, e in known if p == 0)
            got = known.get((piece, entering))
            out.append((piece, list(entering), got is None, through))
            if got is None:
                break
            through = through + 1 if got == entering else 0
            state = got
        frame = pd.DataFrame(out, columns=["__piece", "__enters", "__missing", "__through"])
        for k in keys:
            frame[k] = table[k].iloc[0]
        return frame[fields]

    return run


def speculative_fold(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, flags: Sequence[str], step: Callable, width: int,
    result: str, piece_rows: int = PIECE_ROWS, split: bool | None = None,
) -> DataFrame:
    """``keys``, ``order`` and ``result`` (bigint) of every row.

    ``value`` is an array of numbers, ``flags`` are integers.
    ``step(state, at, flags, vector)`` gives the next state and the result of a
    row; a state is a list of ``width`` slots, None or (row number, vector), and
    a step may put its own row there, keep what is there, or clear it. Rows
    without a key are one group. An empty table gives an empty one. With
    ``split`` false no key is cut.
    """
    keys, order = list(keys), list(order)
    needed = rows.select(*keys, *order, *[f for f in flags if f not in order], value)
    # floats are kept as they are, in half the room, and compared as doubles
    single = rows.schema[value].dataType.simpleString() == "array<float>"
    if split is False:
        whole = needed.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        whole = whole if single else whole.withColumn(value, F.col(value).cast("array<double>"))
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        shape = ", ".join([*(f"`{c}` {types[c]}" for c in [*keys, *order]), f"`{result}` bigint"])
        return whole.mapInArrow(_fold_whole(step, width, [*keys, *order], list(flags), value, result), shape)
    numbered = (
        OrderedScan(needed, keys, order).row_number("__at").apply(split)
        .withColumn("__piece", F.floor((F.col("__at") - 1) / piece_rows).cast("bigint"))
    )
    flag_list = F.array(*[F.col(f).cast("bigint") for f in flags]) if flags else F.array().cast("array<bigint>")
    item = F.struct(
        F.col("__at").alias("at"), flag_list.alias("flags"), (F.col(value) if single else F.col(value).cast("array<double>")).alias("value"), F.struct(*order).alias("order"))
    # at most piece_rows rows in one
    pieces = staged(numbered.groupBy(*keys, "__piece").agg(F.array_sort(F.collect_list(item)).alias("__rows")))
    slots = "array<struct<at:bigint,value:array<double>>>"
    nothing = F.array(*[F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("array<double>").alias("value"))] * width).cast(slots)
    names = [*keys, "__piece", "__entry"]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__piece bigint", f"__entry {slots}", f"__leaving {slots}", "__results array<bigint>"])

    def folded(entries: DataFrame) -> DataFrame:
        renamed = entries.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate([*keys, "__piece"])})
        met = pieces.join(renamed, _same_keys([*keys, "__piece"], [f"__k{i}" for i in range(len(keys) + 1)]))
        return met.select(*keys, "__piece", "__entry", "__rows").mapInArrow(_fold_pieces(step, width, names), shape)

    blank = pieces.withColumn("__entry", nothing).select(*keys, "__piece", "__entry", "__rows").mapInArrow(_fold_pieces(step, width, names), shape)
    last = pieces.agg(F.max("__piece")).first()[0]
    if not last:
        chosen = blank
    else:
        fresh = staged(blank)
        guessed = fresh.select(*keys, (F.col("__piece") + 1).alias("__piece"), F.col("__leaving").alias("__entry"))
        done = staged(fresh.where("__piece = 0").unionByName(folded(guessed)))
        sizes = pieces.groupBy(*keys).agg((F.max("__piece") + 1).alias("__pieces"))
        many = sizes.withColumnsRenamed({k: f"__m{i}" for i, k in enumerate(keys)})
        walk_shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__piece bigint", "__enters array<bigint>", "__missing boolean", "__through bigint"])
        at = lambda c: F.transform(c, lambda s: s["at"])
        while True:
            table = done.select(*keys, "__piece", at("__entry").alias("__enters"), at("__leaving").alias("__leaves")).join(
                many, _same_keys(keys, [f"__m{i}" for i in range(len(keys))])).select(*keys, "__piece", "__enters", "__leaves", "__pieces")
            walked = staged(table.groupBy(*keys).applyInPandas(_followed(keys, walk_shape), walk_shape))
            missing = walked.where("__missing")
            if not missing.take(1):
                break
            ahead = F.explode(F.sequence(F.col("__piece"), F.least(F.col("__piece") + F.col("__through"), F.col("__pieces") - 1)))
            wanted = missing.join(many, _same_keys(keys, [f"__m{i}" for i in range(len(keys))])).select(
                *[F.col(k).alias(f"__w{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__first"), "__enters", ahead.alias("__next"))
            left = done.where(F.col("__piece") >= 0).select(*keys, (F.col("__piece") + 1).alias("__after"), "__leaving", at("__leaving").alias("__leaves"))
            entries = wanted.join(left, _same_keys([f"__w{i}" for i in range(len(keys))], keys) & (F.col("__first") == F.col("__after")) & (F.col("__enters") == F.col("__leaves")))
            entries = entries.select(*keys, F.col("__next").alias("__piece"), F.col("__leaving").alias("__entry")).dropDuplicates([*keys, "__piece"])
            done = staged(done.unionByName(folded(entries)))
        right = walked.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate([*keys, "__piece"])], "__enters")
        chosen = done.join(right, _same_keys([*keys, "__piece"], [f"__r{i}" for i in range(len(keys) + 1)]) & (at("__entry") == F.col("__enters")))
        chosen = chosen.dropDuplicates([*keys, "__piece"])
    ends = chosen.select(*[F.col(k).alias(f"__e{i}") for i, k in enumerate([*keys, "__piece"])], "__results")
    placed = pieces.select(*keys, "__piece", F.transform("__rows", lambda r: r["order"]).alias("__orders")).join(
        ends, _same_keys([*keys, "__piece"], [f"__e{i}" for i in range(len(keys) + 1)]))
    out = placed.select(*keys, F.explode(F.arrays_zip(F.col("__orders").alias("o"), F.col("__results").alias("r"))).alias("__x"))
    return out.select(*keys, *[F.col(f"__x.o.{c}").alias(c) for c in order], F.col("__x.r").alias(result))
