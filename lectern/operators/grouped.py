"""Values of a whole key next to each of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.settings import has_hot_key


def with_group_values(
    df: DataFrame, keys: list[str], values: dict[str, Column], split: bool | None = None
) -> DataFrame:
    """Adds aggregates of each key to its rows.

    Ordinary keys use one window, so a chain of such steps shares one shuffle.
    With ``split`` the aggregates are combined map-side and joined back, and
    the join may split a hot key over several tasks.
    """
    if split is None:
        split = has_hot_key(df.select(*keys), keys)
    if not split:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: v.over(w) for n, v in values.items()})
    grouped = df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(*[v.alias(n) for n, v in values.items()])
    # null-safe: rows without a key form one group, as they do in a window
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(grouped[f"__key{i}"])
    return df.join(grouped, same, "left").select(*[df[c] for c in df.columns if c not in values], *values)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """Rows with the ``values`` of the one row of ``table`` that has their ``keys``: an inner or left join.

    Both go through one window instead of a join. A join deals both sides out by all keys; the
    window keeps rows where they are that are already partitioned by some of the keys.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    types = {f.name: f.dataType for f in table.schema.fields}
    given = rows.select("*", *[F.lit(None).cast(types[v]).alias(v) for v in values], F.lit(False).alias("__table"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in keys]
    held = table.where(known).select(*keys, *values, *blank, F.lit(True).alias("__table"))
    w = Window.partitionBy(*keys)
    met = (given.where(known) if how == "inner" else given).unionByName(held).withColumns(
        {**{v: F.max(v).over(w) for v in values}, "__met": F.bool_or("__table").over(w)})
    return met.where(~F.col("__table") & (F.col("__met") if how == "inner" else F.lit(True))).select(*rows.columns, *values)


def first_by(value: Column, order: Column, where: Column) -> Column:
    """Value of the smallest ``order`` among the rows that meet ``where``."""
    return F.min_by(value, F.when(where, order))
