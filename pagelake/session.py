"""Shared folders for work that must outlive a single Spark job.

Iterative crawls and index builds cut their lineage by writing Parquet tables.
Those tables go under the folder the cluster names in ``spark.checkpoint.dir``,
which every executor can reach, so losing an executor never loses a round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, and the only executor is the driver itself, a folder in the
    warehouse is used. A cluster has to name one: a folder of one machine will not do.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/pagelake-work"


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared root; nothing is created until it is written."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/pagelake/{app}/{label}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table under the shared root: computed once, with no lineage."""
    spark = rows.sparkSession
    path = new_run_dir(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


_tables: dict[str, list[str]] = {}


def created_tables(spark: SparkSession) -> list[str]:
    """Names of the catalog tables this application has made below the shared root."""
    return _tables.setdefault(spark.sparkContext.applicationId, [])


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    Results that were not written elsewhere, and indexes below the shared root, go as well.
    """
    app = spark.sparkContext.applicationId
    for name in _tables.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_path(spark, f"{shared_root(spark)}/pagelake/{app}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of a file, or of all files of a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` if it exists."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
