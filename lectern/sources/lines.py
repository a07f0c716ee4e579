"""Line numbers of files that are read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_lines(rows: DataFrame, name: str = "line_no", whole: bool = False) -> DataFrame:
    """Adds ``file`` and the place of every row in its file, from 1.

    ``rows`` come straight from a file reader. A split is read in order, so a
    row's place in it is the distance of its id to the split's first one; before
    it stand the rows of the file's earlier splits, found by a running sum over
    one row a split. The rows themselves are not shuffled. With ``whole`` the
    numbers go on from file to file, by file name. Row ids only serve to
    subtract: the numbers are the same for any number of splits.
    """
    at = rows.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__from"),
        F.monotonically_increasing_id().alias("__id"))
    splits = at.groupBy("file", "__from").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    if whole:
        along = Window.partitionBy(F.col("__n").isNotNull()).orderBy("file", "__from")
    else:
        along = Window.partitionBy("file").orderBy("__from")
    before = F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    starts = splits.select(F.col("file").alias("__file"), F.col("__from").alias("__start"), "__first", before.alias("__before"))
    placed = at.join(starts, (F.col("file") == F.col("__file")) & (F.col("__from") == F.col("__start")))
    number = F.col("__before") + F.col("__id") - F.col("__first") + 1
    return placed.withColumn(name, number).select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("file", name)], "file", name)
