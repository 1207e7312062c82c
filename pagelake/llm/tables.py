"""Shared helpers of the text operators: tables, intermediate results, free names."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import created_tables, new_run_dir, remove_path

#: Bytes at which ``[\\x20\\x09-\\x0D]`` matches; the white space of words and lines.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes of one Arrow batch. A row may hold a text of megabytes, so batches are short.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of texts small, whatever the default of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def settle(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table in the shared folder: computed once, safe from lost executors.

    What was shuffled on the way is not needed any more; the executors' disks get it back
    once the driver has forgotten the plans, which is why it collects its garbage here.
    """
    spark = rows.sparkSession
    path = new_run_dir(spark, label)
    rows.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    table = spark.read.schema(rows.schema).parquet(path)
    table.settled_at = path
    return table


class SortedRuns:
    """Runs of rows in one table that is bucketed and sorted by ``keys``; a run is a partition.

    All runs have equal buckets, a file for each, so whatever is read of the table is joined
    and grouped by the keys without being shuffled.
    """

    def __init__(self, spark: SparkSession, label: str, keys: list[str], buckets: int):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.path = new_run_dir(spark, label)
        self.name = self.path.rsplit("/", 1)[-1].replace("-", "_")
        self.runs = 0

    def add(self, rows: DataFrame) -> int:
        """Write ``rows``, which are dealt out by the keys already, as one more run."""
        if not self.runs:
            created_tables(self.spark).append(self.name)
        self.runs += 1
        (
            rows.withColumn("run", F.lit(self.runs)).write.mode("append").partitionBy("run")
            .bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet")
            .option("path", self.path).saveAsTable(self.name)
        )
        return self.runs

    def read(self, runs: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(runs)).drop("run")

    def remove(self, runs: list[int]) -> None:
        """Delete runs that nothing reads any more."""
        for run in runs:
            remove_path(self.spark, f"{self.path}/run={run}")
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        if self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            created_tables(self.spark).remove(self.name)
            remove_path(self.spark, self.path)
            self.runs = 0


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        remove_path(table.sparkSession, table.settled_at)


def free_name(rows: DataFrame, wanted: str) -> str:
    """``wanted``, or a variation that no column of ``rows`` has."""
    taken = {name.lower() for name in rows.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
