"""Session-level settings shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of one key that a single window task may hold; larger keys are split
MAX_GROUP_ROWS = 2_000_000

#: rows a task is dealt where whole keys are dealt out for a chain of steps
PART_ROWS = 500_000

#: hash buckets that are counted before single keys are
KEY_BUCKETS = 65_536


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("lectern.maxGroupRows", str(MAX_GROUP_ROWS)))


def parts_of(spark: SparkSession, rows: int) -> int:
    """Parts for a table that is dealt out by key: as many as set, more where a task would get too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; make one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def staged(df: DataFrame) -> DataFrame:
    """A stage result that several later steps read: computed once, kept in the checkpoint folder.

    The folder is shared by the executors, so a lost executor does not bring
    the whole lineage back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def has_hot_key(df: DataFrame, keys: list[str]) -> bool:
    """True when some key has more rows than one task should hold.

    A total below the limit settles the question from file footers, and hash
    buckets that all hold fewer rows settle it without a shuffle of the keys;
    otherwise the counts are combined map-side and only one over-limit row is
    fetched.
    """
    limit = max_group_rows(df.sparkSession)
    if df.count() <= limit:
        return False
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    if not buckets.where(F.col("n") > limit).take(1):
        return False
    over = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return bool(over.take(1))
