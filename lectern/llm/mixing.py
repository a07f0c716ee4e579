"""Mixing of sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, over again when
it is through. A document finishes at the virtual time (tokens of its source
up to and with it) / (target of the source). All queues together, in order of
finish time, are the mixture; it ends where the total budget ends. Long
documents stand in the queue as packets of at most a thousandth of their
source's target, so every source comes within one packet of its target.

Running totals are two-level: sums of shuffle buckets and of ranges of finish
times are added up, and only rows of one bucket or range are ordered together.
A source with a third of all rows is spread like any other. Only keys, sources
and sizes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.quality import SPACE
from lectern.settings import staged

WEIGHTS = (5, 2, 1)
#: all sizes times this is the budget
SHARE = 1.5
PASSES = 2
#: packets that a source's target has at least
GRAIN = 1000
#: rows that a bucket or range holds about
ROWS_TOGETHER = 4096


def sized_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """What mixing needs of a document: its key, source and ``size``, the number of words (null: 0)."""
    words = F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE), "")
    return docs.select(F.col(f"`{key}`"), F.col(f"`{source}`"), F.size(words).cast("bigint").alias("size"))


def _running(whole: Window, *order: str) -> Window:
    return whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, share: float = SHARE, most: int = PASSES
) -> DataFrame:
    """Adds ``queue``, ``target`` and ``budget`` to a table of one row a source.

    Sources by code point, null last, have the weights in turn. Targets share
    ``share`` of all sizes by weight, but none is above ``most`` times its
    size; what that leaves is shared by weight again. Filled up in order of
    size a weight, the sources that stop at their size come first: a source is
    one of them if its limit is below what the level would be without those
    before it. The windows are over sources, not rows.
    """
    every = Window.partitionBy("_all")
    size_, weight = F.col(f"`{size}`"), F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("queue") - 1, F.lit(len(weights))).cast("int") + 1)
    named = sizes.withColumn("_all", F.col(f"`{size}`").isNotNull()).withColumn(
        "queue", F.row_number().over(every.orderBy(F.col(f"`{source}`").asc_nulls_last()))
    ).withColumns({"_weight": weight, "_limit": most * size_, "_budget": share * F.sum(size_).over(every)})
    filled = named.withColumn("_steep", F.col("_limit") / F.col("_weight"))
    before = lambda c: F.sum(c).over(_running(every, "_steep", "queue")) - F.col(c)
    level = (F.col("_budget") - before("_limit")) / (F.sum("_weight").over(every) - before("_weight"))
    marked = filled.withColumn("_full", F.col("_steep") <= level)
    rest = lambda flag, c: F.sum(F.when(flag, F.col(c)).otherwise(0)).over(every)
    shared = F.col("_weight") * (F.col("_budget") - rest(F.col("_full"), "_limit")) / rest(~F.col("_full"), "_weight")
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(shared)
    kept = [F.col(f"`{c}`") for c in sizes.columns]
    return marked.select(*kept, "queue", target.alias("target"), F.floor("_budget").alias("budget"))


def _fraction(mixed: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number from 0 to 1."""
    return F.conv(F.substring(mixed, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _queued(rows: DataFrame, key: str, source: str, size: str, seed: str, cells: int, weights: tuple, share: float, most: int) -> DataFrame:
    """Every row with its queue, its place there and the tokens before it."""
    own = [F.col(f"`{c}`") for c in rows.columns]
    ties = [F.col("k"), *[F.col("row")[c] for c in sorted(set(rows.columns) - {key, source})]]
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.concat(F.lit("null"), F.col("n").cast("string")))))
    laid = rows.select(
        F.struct(*own).alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"),
        F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"),
    ).withColumn("mixed", shuffled).withColumn("bucket", F.floor(_fraction(F.col("mixed")) * cells))
    sums = laid.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    shares = targets(sums.groupBy("s").agg(F.sum("tokens").alias("source_size")), "s", "source_size", weights, share, most)
    along = _running(Window.partitionBy("s"), "bucket")
    offsets = sums.select(
        F.col("s").alias("s_"), F.col("bucket").alias("bucket_"),
        (F.sum("rows").over(along) - F.col("rows")).alias("rows_before"), (F.sum("tokens").over(along) - F.col("tokens")).alias("tokens_before"),
    ).join(shares, F.col("s_").eqNullSafe(F.col("s")), "left").drop("s")
    inside = Window.partitionBy("s", "bucket").orderBy("mixed", *ties)
    ranked = laid.withColumns({"at": F.row_number().over(inside), "upto": F.sum("n").over(_running(Window.partitionBy("s", "bucket"), "mixed", *ties))})
    return ranked.join(offsets, F.col("s").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("bucket_"))).select(
        "row", "n", "mixed", "queue", "source_size", "target", "budget",
        (F.col("rows_before") + F.col("at")).alias("place"), (F.col("tokens_before") + F.col("upto") - F.col("n")).alias("before"),
    )


def _packets(queued: DataFrame, most: int, grain: int) -> DataFrame:
    """Every row as packets of all passes, with finish times. A row without tokens stands anywhere."""
    limit = F.greatest(F.lit(1), F.ceil(F.col("target") / grain))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("limit")))
    dealt = queued.withColumn("limit", limit).withColumn("count", count).withColumn(
        "turn", F.explode(F.sequence(F.lit(0).cast("bigint"), most * F.col("count") - 1)))
    nth = F.pmod(F.col("turn"), F.col("count"))
    done = F.least(F.col("n"), (nth + 1) * F.col("limit"))
    round_ = F.floor(F.col("turn") / F.col("count"))
    finish = F.when(F.col("n") > 0, (round_ * F.col("source_size") + F.col("before") + done) / F.col("target")).otherwise(_fraction(F.col("mixed")))
    return dealt.withColumns({"tokens": done - F.least(F.col("n"), nth * F.col("limit")), "finish": finish})


def mixture(
    rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple = WEIGHTS, share: float = SHARE,
    most: int = PASSES, grain: int = GRAIN, seed: str = "mixing-1",
) -> DataFrame:
    """The mixture itself: packets with ``row``, ``queue``, ``place``, ``turn``, ``finish``, ``position`` and ``served``.

    Ordered by (finish, queue, place, turn), ``position`` is the tokens before
    a packet and ``served`` how many of its tokens are within the budget.
    """
    rows = staged(rows)
    cells = 1 << max(4, (rows.count() // ROWS_TOGETHER).bit_length())
    queued = staged(_queued(rows, key, source, size, seed, cells, weights, share, most))
    packets = _packets(queued, most, grain)
    # finish times are even up to 1, where the mixture ends or nearly so; later ones lie ever wider apart
    spread = F.when(F.col("finish") < 1, F.col("finish")).otherwise(1 + F.log(F.col("finish")))
    packets = packets.withColumn("cell", F.floor(spread * cells))
    sums = packets.groupBy("cell").agg(F.sum("tokens").alias("sum")).withColumn("known", F.col("cell").isNotNull())
    ahead = sums.select(F.col("cell").alias("cell_"), (F.sum("sum").over(_running(Window.partitionBy("known"), "cell")) - F.col("sum")).alias("ahead"))
    inside = _running(Window.partitionBy("cell"), "finish", "queue", "place", "turn")
    placed = packets.withColumn("upto", F.sum("tokens").over(inside)).join(ahead, F.col("cell") == F.col("cell_"))
    position = F.col("ahead") + F.col("upto") - F.col("tokens")
    served = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("budget") - position))
    return placed.select(
        "row", "queue", "place", "turn", "finish", "source_size", "target", position.alias("position"), served.cast("bigint").alias("served"))


def mix_sources(rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", **options) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` (tokens in the mixture, repeats counted) to every row.

    ``options`` are those of ``mixture``. Null or negative sizes count as 0, a
    row of size 0 is never taken, null sources form one source, the last. Rows
    of one source are ordered by md5(seed:key), then the key, then the other
    columns, so ties and repeated rows have a stable place; a null key counts
    as its size. An empty table gives an empty one. Texts of any length are a
    number here. Other columns stay; those named like a result are replaced.
    """
    served = mixture(rows, key, source, size, **options)
    whole = served.groupBy("queue", "place").agg(
        F.first("row").alias("row"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("served").alias("taken"))
    results = ["source_size", "target", "taken"]
    return whole.select(*[F.col("row")[c].alias(c) for c in rows.columns if c not in results], *results)


def oracle_sql(weights: tuple = WEIGHTS, share: float = SHARE, most: int = PASSES, grain: int = GRAIN, seed: str = "mixing-1") -> str:
    """The query's rows by DuckDB: limits found by resharing round by round, one running total over all packets."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS q FROM d GROUP BY source),
w AS (SELECT *, list_extract({list(weights)}, CAST((q - 1) % {len(weights)} + 1 AS BIGINT)) AS w, {most} * size AS lim, {share}::DOUBLE * (SELECT sum(n) FROM d) AS budget FROM s),
r(i, q, lim, w, budget, full_) AS (
  SELECT 0, q, lim, w, budget, false FROM w
  UNION ALL SELECT i + 1, q, lim, w, budget,
    full_ OR lim <= w * (budget - coalesce(sum(lim) FILTER (full_) OVER (), 0)) / (sum(w) FILTER (NOT full_) OVER ()) FROM r WHERE i <= (SELECT count(*) FROM w)),
t AS (SELECT q, budget, CASE WHEN full_ THEN lim::DOUBLE ELSE w * (budget - coalesce(sum(lim) FILTER (full_) OVER (), 0)) / (sum(w) FILTER (NOT full_) OVER ()) END AS target
      FROM r WHERE i = (SELECT max(i) FROM r)),
m AS (SELECT d.*, s.size, t.q, t.target, t.budget, greatest(1, ceil(t.target / {grain}))::BIGINT AS lim,
        md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || n)) AS mixed
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN t USING (q)),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY mixed, doc_id, n) AS place, sum(n) OVER (PARTITION BY q ORDER BY mixed, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS before FROM m),
p AS (SELECT *, unnest(range(0, {most})) AS pass FROM o),
k AS (SELECT *, unnest(range(0, ceil(n / lim)::BIGINT)) AS j FROM p WHERE n > 0),
f AS (SELECT *, least(n, (j + 1) * lim) - j * lim AS tokens, (pass * size + before + least(n, (j + 1) * lim))::DOUBLE / target AS finish FROM k),
c AS (SELECT *, sum(tokens) OVER (ORDER BY finish, q, place, pass, j ROWS UNBOUNDED PRECEDING) - tokens AS position FROM f),
x AS (SELECT q, place, sum(greatest(0, least(tokens, floor(budget) - position))) AS taken FROM c GROUP BY q, place)
SELECT doc_id, CAST(n AS BIGINT) AS size, size AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN x USING (q, place)
"""
