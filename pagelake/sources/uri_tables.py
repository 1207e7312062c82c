"""Tables bucketed and sorted by a key such as the URI, joined by it without a shuffle.

A row's slot is its bucket: the hash Spark buckets by, modulo the number of buckets. Slots
are partitions as well, so a few URIs select the files that can hold them, however many
files there are; and all files together are joined bucket by bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagelake.session import created_tables, new_run_dir

SLOT = "_slot"


def slot(uri: Column, buckets: int) -> Column:
    return F.pmod(F.hash(uri), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class UriTable:
    """A table with a ``key`` column, in ``buckets`` files."""

    spark: SparkSession
    name: str
    buckets: int
    key: str = "uri"

    def read(self) -> DataFrame:
        """All rows; a join on the key finds them in place."""
        return self.spark.table(self.name).drop(SLOT)

    def holding(self, uris: DataFrame) -> DataFrame:
        """The rows of the files that can hold ``uris``.

        The slots asked for come to the driver, at most one number per file.
        """
        wanted = [
            row[0] for row in uris.select(slot(F.col(self.key), self.buckets)).distinct().collect()
        ]
        if len(wanted) == self.buckets:
            return self.read()
        return self.spark.table(self.name).filter(F.col(SLOT).isin(wanted)).drop(SLOT)


def _table_name(spark: SparkSession, label: str) -> str:
    name = f"pagelake_{label}_{uuid.uuid4().hex[:12]}"
    created_tables(spark).append(name)
    return name


def write_uri_table(rows: DataFrame, label: str, buckets: int, key: str = "uri") -> UriTable:
    """``rows``, which have a column ``key``, as a table; they are shuffled once, here."""
    spark = rows.sparkSession
    name = _table_name(spark, label)
    (
        rows.withColumn(SLOT, slot(F.col(key), buckets)).repartition(buckets, key)
        .write.partitionBy(SLOT).bucketBy(buckets, key).sortBy(key).format("parquet")
        .option("path", new_run_dir(spark, label)).saveAsTable(name)
    )
    return UriTable(spark, name, buckets, key)


class Levels:
    """The URIs attempted at each level of a crawl: a table bucketed by URI that grows.

    Levels are partitions, so the newest one is read alone; all of them are the visited
    set, against which candidates are compared without shuffling it.
    """

    def __init__(self, spark: SparkSession, label: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.name = _table_name(spark, label)
        self.path = new_run_dir(spark, label)
        self.depth = 0

    def add(self, frontier: DataFrame) -> int:
        """Write the next level and return its size, counted while it is written."""
        size = Observation()
        (
            frontier.observe(size, F.count(F.lit(1)).alias("rows"))
            .withColumn("level", F.lit(self.depth))
            .write.mode("append").partitionBy("level").bucketBy(self.buckets, "uri").sortBy("uri")
            .format("parquet").option("path", self.path).saveAsTable(self.name)
        )
        self.depth += 1
        return size.get["rows"]

    def newest(self) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("level") == self.depth - 1).drop("level")

    def visited(self) -> DataFrame:
        return self.spark.table(self.name)

    def unvisited(self, candidates: DataFrame) -> DataFrame:
        """The candidates no level has attempted yet.

        More partitions than buckets would make Spark shuffle the visited set instead. So
        the candidates are dealt to the buckets, below which it would push an anti-join.
        """
        visited = self.visited().select("uri")
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) <= self.buckets:
            return candidates.join(visited, "uri", "left_anti")
        dealt = candidates.repartition(self.buckets, "uri")
        return dealt.join(visited.withColumn("_seen", F.lit(True)), "uri", "left").filter(
            "_seen IS NULL"
        ).drop("_seen")
