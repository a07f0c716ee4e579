"""Ordered per-key computations that also work when one key is very large.

``OrderedScan`` gathers running sums, running maxima, max-plus recurrences,
neighbours and row numbers over ``keys`` in the order of ``order``.  For ordinary keys it is one
window.  With ``split=True`` the rows are range-partitioned on keys + order, so
a hot key is spread over many tasks; each piece is scanned on its own and the
values carried from piece to piece come from a table with at most two rows per
partition, which is therefore always small enough to broadcast.

The order columns must identify a row within its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.settings import ensure_checkpoint_dir, has_hot_key

_PIECE = "__scan_piece"
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


@dataclass(frozen=True)
class _Item:
    kind: str
    name: str
    value: Column


def _reversed(order: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in order]


_PAIRS = ("max_plus", "max_plus_before")


def _pair_value(kind: str, pair: Column, total: Column, w, entry: Column) -> Column:
    """A max-plus recurrence where ``total`` is the running sum of its first parts and ``entry`` what came in.

    x' = max(x + a, b) is the pair (a, b), and pairs compose: the running sum of
    the a, and the largest of the b less the sum up to them.
    """
    reached = F.max(pair["b"] - total).over(w.rowsBetween(*(_UPTO if kind == "max_plus" else _BEFORE)))
    return (total if kind == "max_plus" else total - pair["a"]) + F.greatest(entry, reached)


def _window_value(kind: str, value: Column, w, back) -> Column:
    """``back`` is the window in reverse order: looking ahead over it stays linear."""
    if kind == "row_number":
        return F.row_number().over(w).cast("bigint")
    if kind == "sum":
        return F.sum(value).over(w.rowsBetween(*_UPTO))
    if kind == "sum_before":
        return F.sum(value).over(w.rowsBetween(*_BEFORE))
    if kind == "max":
        return F.max(value).over(w.rowsBetween(*_UPTO))
    if kind == "max_before":
        return F.max(value).over(w.rowsBetween(*_BEFORE))
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w.rowsBetween(*_UPTO))
    if kind == "last_before":
        return F.last(value, ignorenulls=True).over(w.rowsBetween(*_BEFORE))
    if kind == "next":
        return F.last(value, ignorenulls=True).over(back.rowsBetween(*_BEFORE))
    if kind == "lag":
        return F.lag(value).over(w)
    if kind == "lead":
        return F.lead(value).over(w)
    if kind == "total":
        return F.sum(value).over(w.rowsBetween(*_ALL))
    if kind == "whole_max":
        return F.max(value).over(w.rowsBetween(*_ALL))
    raise ValueError(kind)


class OrderedScan:
    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.df, self.keys, self.order = df, list(keys), list(order)
        self.items: list[_Item] = []

    def _add(self, kind: str, name: str, value: Column | str) -> OrderedScan:
        col = F.col(value) if isinstance(value, str) else value
        self.items.append(_Item(kind, name, col))
        return self

    def row_number(self, name: str) -> OrderedScan:
        return self._add("row_number", name, F.lit(1))

    def running_sum(self, name: str, value) -> OrderedScan:
        return self._add("sum", name, value)

    def sum_before(self, name: str, value) -> OrderedScan:
        """Sum of the rows before this one; null where none of them has a value."""
        return self._add("sum_before", name, value)

    def running_max(self, name: str, value) -> OrderedScan:
        return self._add("max", name, value)

    def max_before(self, name: str, value) -> OrderedScan:
        return self._add("max_before", name, value)

    def last_value(self, name: str, value) -> OrderedScan:
        """Latest non-null value up to and including this row."""
        return self._add("last", name, value)

    def last_before(self, name: str, value) -> OrderedScan:
        return self._add("last_before", name, value)

    def next_value(self, name: str, value) -> OrderedScan:
        """First non-null value after this row."""
        return self._add("next", name, value)

    def lag(self, name: str, value) -> OrderedScan:
        return self._add("lag", name, value)

    def lead(self, name: str, value) -> OrderedScan:
        return self._add("lead", name, value)

    def total(self, name: str, value) -> OrderedScan:
        return self._add("total", name, value)

    def whole_max(self, name: str, value) -> OrderedScan:
        return self._add("whole_max", name, value)

    def max_plus(self, name: str, a, b) -> OrderedScan:
        """x = max(x before + a, b), from 0; a null b adds nothing."""
        return self._add("max_plus", name, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")))

    def max_plus_before(self, name: str, a, b) -> OrderedScan:
        """The value of ``max_plus`` before this row."""
        return self._add("max_plus_before", name, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")))

    def apply(self, split: bool | None = None) -> DataFrame:
        if split is None:
            split = has_hot_key(self.df.select(*self.keys), self.keys)
        return self._split() if split else self._plain()

    def _plain(self) -> DataFrame:
        keyed = Window.partitionBy(*self.keys)
        w, back = keyed.orderBy(*self.order), keyed.orderBy(*_reversed(self.order))
        pairs = {n: i for n, i in enumerate(self.items) if i.kind in _PAIRS}
        df = self.df.withColumns({f"__scan_p{n}": i.value for n, i in pairs.items()}) if pairs else self.df
        if pairs:
            df = df.withColumns({f"__scan_s{n}": F.sum(F.col(f"__scan_p{n}")["a"]).over(w.rowsBetween(*_UPTO)) for n in pairs})
        zero = F.lit(0).cast("bigint")
        values = {
            i.name: _pair_value(i.kind, F.col(f"__scan_p{n}"), F.col(f"__scan_s{n}"), w, zero) if n in pairs else _window_value(i.kind, i.value, w, back)
            for n, i in enumerate(self.items)
        }
        return df.withColumns(values).drop(*[f"__scan_{c}{n}" for n in pairs for c in "ps"])

    def _split(self) -> DataFrame:
        spark = self.df.sparkSession
        ensure_checkpoint_dir(spark)
        pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = [f"__scan_v{n}" for n in range(len(self.items))]
        rows = (
            self.df.withColumns({n: i.value for n, i in zip(names, self.items)})
            .repartitionByRange(pieces, *self.keys, *self.order)
            .withColumn(_PIECE, F.spark_partition_id())
            # both branches below must see the same piece boundaries
            .checkpoint()
        )
        piece = Window.partitionBy(*self.keys, _PIECE)
        local, back = piece.orderBy(*self.order), piece.orderBy(*_reversed(self.order))
        at = F.struct(*self.order)

        summed = {f"{n}_s": F.sum(F.col(n)["a"]).over(local.rowsBetween(*_UPTO)) for n, i in zip(names, self.items) if i.kind in _PAIRS}
        rows = rows.withColumns(summed) if summed else rows
        aggs: list[Column] = []
        for n, i in zip(names, self.items):
            v = F.col(n)
            known = F.when(v.isNotNull(), at)
            if i.kind in _PAIRS:
                aggs.append(F.struct(F.sum(v["a"]).alias("a"), F.max(v["b"] - F.col(f"{n}_s")).alias("b")).alias(n))
            elif i.kind == "row_number":
                aggs.append(F.count(F.lit(1)).alias(n))
            elif i.kind in ("sum", "sum_before", "total"):
                aggs.append(F.sum(v).alias(n))
            elif i.kind in ("max", "max_before", "whole_max"):
                aggs.append(F.max(v).alias(n))
            elif i.kind in ("last", "last_before"):
                aggs.append(F.max_by(v, known).alias(n))
            elif i.kind == "next":
                aggs.append(F.min_by(v, known).alias(n))
            elif i.kind == "lag":
                aggs.append(F.max_by(v, at).alias(n))
            elif i.kind == "lead":
                aggs.append(F.min_by(v, at).alias(n))
        by_key = Window.partitionBy(*self.keys).orderBy(_PIECE)
        whole = Window.partitionBy(*self.keys)
        by_key_back = whole.orderBy(F.desc(_PIECE))
        carried: list[Column] = []
        for n, i in zip(names, self.items):
            v = F.col(n)
            if i.kind in _PAIRS:
                # what came in at this piece: sums of the pieces before it, and the furthest any of them reached
                c = F.coalesce(F.col(f"{n}_b"), F.lit(0)) + F.greatest(
                    F.lit(0), F.max(v["b"] - F.coalesce(F.col(f"{n}_b"), F.lit(0))).over(by_key.rowsBetween(*_BEFORE)))
            elif i.kind in ("row_number", "sum", "sum_before"):
                c = F.sum(v).over(by_key.rowsBetween(*_BEFORE))
            elif i.kind == "total":
                c = F.sum(v).over(whole)
            elif i.kind == "whole_max":
                c = F.max(v).over(whole)
            elif i.kind in ("max", "max_before"):
                c = F.max(v).over(by_key.rowsBetween(*_BEFORE))
            elif i.kind in ("last", "last_before"):
                c = F.last(v, ignorenulls=True).over(by_key.rowsBetween(*_BEFORE))
            elif i.kind == "next":
                c = F.last(v, ignorenulls=True).over(by_key_back.rowsBetween(*_BEFORE))
            elif i.kind == "lag":
                c = F.lag(v).over(by_key)
            else:
                c = F.lead(v).over(by_key)
            carried.append(c.alias(f"{n}_c"))
        carry = (
            rows.groupBy(*self.keys, _PIECE)
            .agg(*aggs)
            .select("*", *[F.sum(F.col(n)["a"]).over(by_key.rowsBetween(*_BEFORE)).alias(f"{n}_b") for n, i in zip(names, self.items) if i.kind in _PAIRS])
            .select(*self.keys, _PIECE, F.count(F.lit(1)).over(whole).alias("__scan_n"), *carried)
            # keys inside one piece carry nothing: what is left has <= 2 rows per piece
            .where(F.col("__scan_n") > 1)
            .drop("__scan_n")
        )
        out = {}
        for n, i in zip(names, self.items):
            if i.kind in _PAIRS:
                upto = _UPTO if i.kind == "max_plus" else _BEFORE
                out[f"{n}_l"] = F.max(F.col(n)["b"] - F.col(f"{n}_s")).over(local.rowsBetween(*upto))
            else:
                out[f"{n}_l"] = _window_value(i.kind, F.col(n), local, back)
        scanned = rows.withColumns(
            {
                **out,
                "__scan_first": F.row_number().over(local) == 1,
                "__scan_final": F.lead(F.lit(1)).over(local).isNull(),
            }
        )
        # null-safe: rows without a key form one group, as they do in a window
        renamed = carry.withColumnsRenamed({k: f"__scan_key{i}" for i, k in enumerate([*self.keys, _PIECE])})
        same = F.lit(True)
        for i, k in enumerate([*self.keys, _PIECE]):
            same = same & scanned[k].eqNullSafe(renamed[f"__scan_key{i}"])
        joined = scanned.join(F.broadcast(renamed), same, "left")
        final = {}
        for n, i in zip(names, self.items):
            own, c = F.col(f"{n}_l"), F.col(f"{n}_c")
            if i.kind in _PAIRS:
                total = F.col(f"{n}_s") - (F.lit(0) if i.kind == "max_plus" else F.col(n)["a"])
                v = total + F.greatest(F.coalesce(c, F.lit(0).cast("bigint")), own)
            elif i.kind in ("row_number", "sum", "sum_before"):
                v = F.when(c.isNull(), own).otherwise(F.coalesce(own, F.lit(0)) + c)
            elif i.kind in ("total", "whole_max"):
                v = F.coalesce(c, own)
            elif i.kind in ("max", "max_before"):
                v = F.greatest(own, c)
            elif i.kind in ("last", "last_before", "next"):
                v = F.coalesce(own, c)
            elif i.kind == "lag":
                v = F.when(F.col("__scan_first"), c).otherwise(own)
            else:
                v = F.when(F.col("__scan_final"), c).otherwise(own)
            final[i.name] = v
        base = [c for c in self.df.columns if c not in final]
        return joined.select(*base, *[v.alias(k) for k, v in final.items()])
