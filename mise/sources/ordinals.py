"""Input order as a column: dense positions of records over files and splits.

Records are read in file order (by path) and, inside a file, from its beginning.  Spark
packs splits into tasks by size, so neither the task number nor an increasing id
follows that order; but each split is read by one task from front to back.  So a
record's position is the number of records in all earlier splits plus its place in its own.

Splits are counted by a partial aggregate (one small row for each), range-partitioned by
(file, start) and added up in two steps: inside each range and over the ranges' sums, of
which there are as many as shuffle partitions.  No record is sorted or moved for its
number, except where the table of splits is too large to be broadcast after it was measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_FILE, _START, _ID, _SPLIT = "_pos_file", "_pos_start", "_pos_id", "_pos_split"


def split_offsets(read: DataFrame) -> DataFrame:
    """(file, start, first id, records before) of each split, from rows that carry file, start and id."""
    spark = read.sparkSession
    splits = read.groupBy(_FILE, _START).agg(F.min(_ID).alias("_first"), F.count(F.lit(1)).alias("_n"))
    path = scratch_path(spark, "input-splits")
    (splits.repartitionByRange(_FILE, _START).withColumn("_range", F.spark_partition_id())
     .write.parquet(path))
    splits = spark.read.parquet(path)
    # One row for each range: a window over them all is a small task, and their number is a setting.
    sums = splits.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ranges_before"))
    inside = Window.partitionBy("_range").orderBy(_FILE, _START).rowsBetween(Window.unboundedPreceding, -1)
    counted = splits.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return counted.join(F.broadcast(ranges), "_range").select(
        _FILE, _START, "_first", (F.col("_ranges_before") + F.col("_inside")).alias("_before"))


def with_input_pos(read: DataFrame, name: str = "input_pos", first: int = 0) -> DataFrame:
    """``read``, straight from a file reader, with each record's dense position in input order.

    An empty file holds no position.  Records are all that the reader returns, blank lines
    of a text file included.
    """
    if name in read.columns:
        raise ValueError(f"there is a column {name!r}")
    marked = read.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START),
                         F.monotonically_increasing_id().alias(_ID))
    offsets = split_offsets(marked)
    at = offsets.select(F.col(_FILE).alias("_f"), F.col(_START).alias("_s"), "_first", "_before")
    joined = marked.join(at, (F.col(_FILE) == F.col("_f")) & (F.col(_START) == F.col("_s")))
    return joined.select(*read.columns, (F.col("_before") + F.col(_ID) - F.col("_first") + F.lit(first)).alias(name))
