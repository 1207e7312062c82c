"""Page snapshots stand in for the web: fetching a URI is a join against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import urls


def snapshot_from_pages(pages: DataFrame, uri: str = "url", html: str = "html") -> DataFrame:
    """Response-shaped rows from a plain (uri, html) table."""
    address = urls.without_fragment(F.col(uri))
    return pages.select(
        address.alias("uri"),
        F.array(address).alias("trace_redirects"),
        F.lit(200).alias("status"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.col(html).alias("body"),
    )


def snapshot_from_files(spark: SparkSession, path: str, base_uri: str) -> DataFrame:
    """One page per HTML file under ``path``, addressed relative to ``base_uri``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.input_file_name(), r"[^/]+$", 0)
    pages = files.select(
        F.concat(F.lit(base_uri.rstrip("/") + "/"), name).alias("url"),
        F.col("value").alias("html"),
    )
    return snapshot_from_pages(pages)


def successful(snapshot: DataFrame) -> DataFrame:
    """The responses that count as fetched: error statuses (400 and above) do not.

    A snapshot without statuses, or a null status, is taken as it is.
    """
    if "status" not in snapshot.columns:
        return snapshot
    return snapshot.filter(F.coalesce(F.col("status") < 400, F.lit(True)))


def one_per_uri(snapshot: DataFrame) -> DataFrame:
    """One response per URI: of several, the one whose body has the smallest hash.

    Only the URIs are grouped. Bodies move for the URIs that have several responses, and
    for no others.
    """
    several = snapshot.groupBy("uri").count().filter("count > 1").select("uri")
    if several.isEmpty():
        return snapshot
    columns = snapshot.columns
    apart = snapshot.join(several, "uri", "left_anti").select(*columns)
    order = F.struct(F.xxhash64("body"), F.col("body"))
    chosen = snapshot.join(several, "uri", "left_semi").groupBy("uri").agg(
        F.min_by(F.struct(*columns), order).alias("chosen")
    )
    return apart.unionByName(chosen.select("chosen.*"))


def fetch(frontier: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every frontier row with its response; a null ``status`` is a failed fetch."""
    return frontier.join(snapshot, "uri", "left")


def fetch_existing(frontier: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Only the frontier rows whose fetch succeeds."""
    return frontier.join(snapshot, "uri", "inner")
