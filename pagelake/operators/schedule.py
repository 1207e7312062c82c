"""Polite fetching: when each URI may be requested, and whether a crawl kept to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.ordering import number_within, previous_within


def fetch_schedule(
    requests: DataFrame, start: str, delay_ms: int, host: str = "host",
    order: list[str] | None = None,
) -> DataFrame:
    """Add ``fetch_at``: requests to one host are ``delay_ms`` apart, hosts independent."""
    placed = number_within(requests, host, order or ["seq"])
    start_us = F.unix_micros(F.lit(start).cast("timestamp"))
    fetch_us = start_us + F.lit(delay_ms * 1000) * (F.col("position") - 1)
    return placed.withColumn("fetch_at", F.timestamp_micros(fetch_us))


def politeness_audit(
    fetched: DataFrame, delay_ms: int, host: str = "host", at: str = "crawled_at",
    tie_break: str = "doc_id",
) -> DataFrame:
    """Add the gap to the host's previous request, and whether it exceeds the delay."""
    paced = previous_within(fetched, host, [at, tie_break], at, "previous_at")
    gap_us = F.unix_micros(F.col(at)) - F.unix_micros(F.col("previous_at"))
    return paced.withColumn("gap_us", gap_us).withColumn(
        "polite", F.coalesce(F.col("gap_us") > F.lit(delay_ms * 1000), F.lit(True))
    )
