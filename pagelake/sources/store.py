"""The page store: crawled pages and scrape results as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.times import instant
from pagelake.schemas import PAGE_KIND, SCRAPE_KIND
from pagelake.session import path_exists

PARTITIONS = ["crawl_tag", "crawl_timestamp"]


def document_id(*parts: Column) -> Column:
    """A stable id: the same page, run and instant give the same id in any attempt."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws("\n", *texts), 256)


def stamp_pages(
    fetched: DataFrame, crawl_tag: str, crawl_timestamp: Column | str, now: Column | str,
    score: Column | None = None,
) -> DataFrame:
    """Responses with the identity of their crawl run, ready to be appended.

    ``now`` is an argument, so a retried task stamps the same instant.
    """
    stamped = fetched.withColumns({
        "crawl_tag": F.lit(crawl_tag),
        "crawl_timestamp": instant(crawl_timestamp),
        "crawled_at": instant(now),
        "score": (F.lit(None) if score is None else score).cast("double"),
    })
    identity = document_id(
        F.col("crawl_tag"), F.col("crawl_timestamp"), F.col("uri"), F.col("crawled_at")
    )
    return stamped.withColumn("doc_id", identity)


#: Rows of one file, so that a file is a bounded read.
ROWS_PER_FILE = 50_000
CLUSTERED_BY = ["uri", "crawled_at", "doc_id"]


def _clustered(documents: DataFrame) -> DataFrame:
    order = [*PARTITIONS, *[name for name in CLUSTERED_BY if name in documents.columns]]
    return documents.repartitionByRange(*order).sortWithinPartitions(*order)


def append_documents(documents: DataFrame, path: str) -> None:
    """Add documents; existing ones are never touched.

    Rows are dealt out and sorted by run and URI: each file holds a range of a run, and its
    statistics tell which. A large run spreads over many files. Range bounds are sampled,
    so ``documents`` should be cheap to compute twice, such as a table.
    """
    _clustered(documents).write.mode("append").option(
        "maxRecordsPerFile", ROWS_PER_FILE
    ).partitionBy(*PARTITIONS).parquet(path)


def replace_run(documents: DataFrame, path: str) -> None:
    """Write documents, replacing only the runs they belong to."""
    (
        _clustered(documents).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored documents, or none where nothing has been stored yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def with_kind(documents: DataFrame, kind: str) -> DataFrame:
    return documents.withColumn("type", F.lit(kind))


def mixed_documents(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Both record kinds in one table, told apart by ``type``."""
    return with_kind(pages, PAGE_KIND).unionByName(
        with_kind(results, SCRAPE_KIND), allowMissingColumns=True
    )


def of_kind(documents: DataFrame, kind: str) -> DataFrame:
    return documents.filter(F.col("type") == kind)
