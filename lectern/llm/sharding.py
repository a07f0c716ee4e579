"""Proportional stratified interleaving of rows into shards.

Rows of each stratum are ranked in a seeded shuffle, all rows are ordered by
their fractional rank, and that order is cut into shards of equal counts, so
every shard has the mixture of the whole. Ranks are two-level: counts of
shuffle buckets are added up, and only rows of one bucket are ranked together,
so a stratum with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def shard_mixture(
    rows: DataFrame, key: str = "doc_id", stratum: str = "source", shards: int = 16, seed: str = "mixture-1",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Adds ``shard`` and ``slot`` to every row; counts of shards differ by one at most.

    The order within a stratum is that of md5(seed:key), then the key, then
    the other columns, so ties and repeated rows have a stable place. Null
    strata form one stratum, null keys count as empty text, an empty table stays
    empty. Other columns stay as they are, whatever their names, but those named
    ``shard`` or ``slot`` are replaced. Carry narrow rows only; join wide ones by
    shard and slot.
    """
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{stratum}`").alias("s"), mixed.alias("mixed"))
    row = F.col("row")
    ties = [row[key], *[row[c] for c in sorted(set(rows.columns) - {key, stratum})]]
    cell = (F.conv(F.substring("mixed", 1, 8), 16, 10).cast("bigint") * buckets).bitwiseAND(~0xFFFFFFFF) / (1 << 32)
    laid = packed.withColumn("cell", cell.cast("int"))
    counts = laid.groupBy(F.col("s").alias("s_"), F.col("cell").alias("c_")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("s_")
    offsets = counts.select(
        "s_", "c_", F.sum("n").over(own).alias("of"),
        (F.sum("n").over(own.orderBy("c_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("s", "cell").orderBy("mixed", *ties))
    ranked = laid.withColumn("rank", rank).join(offsets, F.col("s").eqNullSafe(F.col("s_")) & (F.col("cell") == F.col("c_"))).select(
        "row", "s", "mixed", ((2 * (F.col("before") + F.col("rank")) - 1) / (2.0 * F.col("of"))).alias("at"))
    placed = ranked.withColumn("cell", F.floor(F.col("at") * buckets).cast("int"))
    cells = placed.groupBy(F.col("cell").alias("c_")).agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("c_").isNotNull())
    # one row for each of the buckets, whatever the input
    everything = Window.partitionBy("known")
    ahead = cells.select(
        "c_", F.sum("n").over(everything).alias("all_rows"),
        (F.sum("n").over(everything.orderBy("c_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"),
    )
    within = F.row_number().over(Window.partitionBy("cell").orderBy("at", "s", "mixed", *ties))
    # at most one row for each of the buckets, whatever the input
    final = placed.withColumn("within", within).join(F.broadcast(ahead), F.col("cell") == F.col("c_"))
    final = final.withColumn("place", F.col("ahead") + F.col("within") - 1).withColumn("shard", F.expr(f"(place * {shards}) div all_rows").cast("int"))
    slot = F.col("place") - F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    return final.select(*[row[c].alias(c) for c in kept], "shard", slot.cast("bigint").alias("slot"))


def measured_rows(docs: DataFrame, key: str = "doc_id", stratum: str = "source", text: str = "text") -> DataFrame:
    """What sharding needs of a document: UTF-8 bytes of the text plus one, and its CRC-32 (null: no bytes)."""
    given = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        key, stratum, (F.octet_length(given).cast("bigint") + 1).alias("size"), F.crc32(given.cast("binary")).alias("text_crc32")
    )


def oracle_sql(shards: int = 16, seed: str = "mixture-1") -> str:
    return f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS t),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM documents, crc),
m AS (SELECT *, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed FROM d),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY mixed, doc_id, size, text_crc32) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS frac FROM m),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, mixed, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * {shards} // n AS INTEGER) AS shard,
  CAST(place - ((place * {shards} // n) * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
