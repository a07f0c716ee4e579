"""Writers: flat CSV, JSON payloads, subtitles and published snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StructType


def flatten(df: DataFrame) -> DataFrame:
    """Columns as CSV cells: id lists joined by ``;``, other nested values as JSON, lower-case booleans, blanks for null."""
    def cell(field) -> Column:
        c, t = F.col(field.name), field.dataType
        if isinstance(t, ArrayType) and isinstance(t.elementType, LongType):
            c = F.array_join(F.transform(c, lambda v: v.cast("string")), ";")
        elif isinstance(t, (ArrayType, StructType, MapType)):
            c = F.to_json(c)
        elif isinstance(t, BooleanType):
            c = F.lower(c.cast("string"))
        else:
            c = c.cast("string")
        return F.coalesce(c, F.lit("")).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_flat(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def payloads(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row counts and rows of each key as one JSON document.

    A document per key is the format itself; for large keys write the rows as a table.
    """
    body = F.struct(*[c for c in rows.columns if c not in keys])
    items = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), body.alias("r"))))
    return rows.groupBy(*keys).agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("event_count"), F.transform(items, lambda i: i["r"]).alias("events"))).alias("payload"))


def write_payloads(rows: DataFrame, keys: list[str], order: list[str], path: str) -> None:
    payloads(rows, keys, order).write.mode("overwrite").partitionBy(*keys).text(path)


def write_srt(cues: DataFrame, path: str) -> None:
    """Subtitle files, a folder per video; cues are sorted inside their partition.

    The time goes into opening files, not into bytes, so the partitions must not
    be merged by their size; by a hash of their own, cues that come out of a
    window by video are dealt out anew as well.
    """
    parts = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        cues.repartition(parts, F.xxhash64("video_id")).sortWithinPartitions("video_id", "cue_no")
        .select("video_id", "cue").write.mode("overwrite").partitionBy("video_id").text(path)
    )


def write_bucketed(rows: DataFrame, keys: list[str], order: list[str], path: str, buckets: int | None = None) -> None:
    """Rows of very many keys in few files, with an index: key -> file, first row, rows.

    Rows are dealt by a hash of the key and sorted inside a file, so the rows of
    a key lie in one file in a row, in their order; the number of files is that
    of the buckets (the shuffle partitions, if not given). The index is read back
    from what was written.
    """
    spark = rows.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(count, *keys).sortWithinPartitions(*keys, *order).write.mode("overwrite").parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data").select(
        *keys, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("__at"))
    index = written.groupBy(*keys, "file").agg(F.min("__at").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    index.coalesce(max(1, count // 8)).write.mode("overwrite").parquet(f"{path}/index")


def read_bucketed(spark: SparkSession, path: str, key: dict, order: list[str]) -> DataFrame:
    """The rows of one key, from the one file that holds them; no rows if the key is unknown."""
    same = F.lit(True)
    for name, value in key.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    found = spark.read.parquet(f"{path}/index").where(same).select("file").take(1)
    data = spark.read.parquet(f"{path}/data/{found[0]['file']}") if found else spark.read.parquet(f"{path}/data").where(F.lit(False))
    return data.where(same).orderBy(*order)


def publish(df: DataFrame, path: str, snapshot: str) -> None:
    """Write a snapshot, then point to it: readers never see half of one."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")
    pointer = df.sparkSession.range(1).select(F.lit(snapshot).alias("snapshot"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/_latest")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that was published last, whatever its name; of two at one instant the later name."""
    pointers = spark.read.parquet(f"{path}/_latest")
    latest = pointers.agg(F.max_by("snapshot", F.struct("published_at", "snapshot"))).first()[0]
    return spark.read.parquet(f"{path}/snapshot={latest}")
