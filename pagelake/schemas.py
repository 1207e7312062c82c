"""Table layouts shared by the sources, operators and plans."""

from __future__ import annotations

from pyspark.sql import types as T

SNAPSHOT = T.StructType([
    T.StructField("uri", T.StringType(), False),
    T.StructField("trace_redirects", T.ArrayType(T.StringType())),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
])

CRAWLED_PAGE = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("crawl_tag", T.StringType(), False),
    T.StructField("crawl_timestamp", T.TimestampType(), False),
    T.StructField("uri", T.StringType(), False),
    T.StructField("crawled_at", T.TimestampType(), False),
    T.StructField("score", T.DoubleType()),
    T.StructField("trace_redirects", T.ArrayType(T.StringType())),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
])

SCRAPE_KEYS = ["doc_id", "type", "crawl_tag", "crawl_timestamp", "uri", "crawled_at"]

PAGE_KIND = "crawled-page"
SCRAPE_KIND = "scrape-result"

NODE = T.StructType([
    T.StructField("pre", T.IntegerType(), False),
    T.StructField("post", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("own_text", T.StringType(), False),
    T.StructField("nth_of_type", T.IntegerType(), False),
])
NODES = T.ArrayType(NODE, False)
