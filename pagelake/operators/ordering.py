"""Per-group order without putting a whole group into one task.

A plain window over ``host`` sorts each host in a single task, which fails when one host
holds a third of all rows. Here rows are range-partitioned by (group, order), so a large
group spans many tasks, and a small table of per-task totals carries the running state
across task boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import new_run_dir


def sorted_blocks(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with their ``_block`` (a range of the global order) and place ``_at`` in it.

    The result is written to the shared folder: block numbers come from sampled range
    bounds, so they must be fixed before two consumers may rely on them.
    """
    spark = rows.sparkSession
    path = new_run_dir(spark, "blocks")
    (
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def _block_starts(blocks: DataFrame, group: str) -> DataFrame:
    """Per (group, block): its first place and how many rows precede it in the group."""
    totals = blocks.groupBy(group, "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    earlier = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        group, "_block", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )


def _join_blocks(blocks: DataFrame, totals: DataFrame, group: str) -> DataFrame:
    """Attach per-block totals; the comparison keeps rows whose group is null."""
    renamed = totals.withColumnsRenamed({group: "_group", "_block": "_of"})
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of"))
    return blocks.join(renamed, same).drop("_group", "_of")


def number_within(
    rows: DataFrame, group: str, order: list[str], name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in its group's order."""
    blocks = sorted_blocks(rows, group, order)
    starts = _block_starts(blocks, group)
    position = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return (
        _join_blocks(blocks, starts, group)
        .withColumn(name, position)
        .drop("_block", "_at", "_first", "_before")
    )


def previous_within(
    rows: DataFrame, group: str, order: list[str], value: str, name: str = "previous"
) -> DataFrame:
    """Add ``value`` of the preceding row in the group's order; null for the first."""
    blocks = sorted_blocks(rows, group, order)
    last = blocks.groupBy(group, "_block").agg(F.max_by(value, "_at").alias("_last"))
    earlier = W.partitionBy(group).orderBy("_block")
    carried = last.select(group, "_block", F.lag("_last").over(earlier).alias("_carried"))
    inside = W.partitionBy(group, "_block").orderBy("_at")
    return (
        blocks.withColumn("_inside", F.lag(value).over(inside))
        .withColumn("_leads", F.row_number().over(inside) == 1)
        .transform(lambda marked: _join_blocks(marked, carried, group))
        .withColumn(name, F.when(F.col("_leads"), F.col("_carried")).otherwise(F.col("_inside")))
        .drop("_block", "_at", "_inside", "_leads", "_carried")
    )


def number_all(rows: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in the order of ``keys``, block by block."""
    spark = rows.sparkSession
    path = new_run_dir(spark, "ordered")
    (
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    # One row per block: as many as there are tasks, whatever the number of rows.
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_block").alias("_of"), "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    return (
        blocks.join(F.broadcast(starts), F.col("_block") == F.col("_of"))
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_block", "_at", "_of", "_first", "_before")
    )
