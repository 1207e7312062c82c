"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_text_table(
    spark: SparkSession, path: str, key: str, partitions: int | None = None
) -> DataFrame:
    """A table whose text column is costly to process, read as it lies.

    A file with a single row group gives a single task however many cores there are. A
    caller who knows of such files may ask for ``partitions``, which spreads the rows by
    ``key`` with a shuffle.
    """
    table = spark.read.parquet(path)
    return table if partitions is None else table.repartition(partitions, key)
