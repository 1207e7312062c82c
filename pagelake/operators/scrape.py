"""Scrape jobs: every page of a run to one result row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.times import instant
from pagelake.schemas import SCRAPE_KIND
from pagelake.sources.store import document_id

METADATA = ["uri", "crawled_at", "crawl_tag", "crawl_timestamp"]


def scrape(pages: DataFrame, columns: Mapping[str, Column] | None) -> DataFrame:
    """One result per page: the user's columns plus the page's identity.

    Identity columns win over user columns of the same name, and without user columns
    the result is identity only. A projection: no shuffle, works on streams too.
    """
    reserved = {*METADATA, "type", "doc_id"}
    extracted = {
        name: column for name, column in (columns or {}).items() if name not in reserved
    }
    identity = document_id(
        F.lit(SCRAPE_KIND), F.col("crawl_tag"), F.col("crawl_timestamp"), F.col("uri"),
        F.col("crawled_at"),
    )
    return pages.select(
        identity.alias("doc_id"),
        F.lit(SCRAPE_KIND).alias("type"),
        *METADATA,
        *[column.alias(name) for name, column in extracted.items()],
    )


def scrape_with(
    pages: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame | None],
    schema: T.StructType,
) -> DataFrame:
    """:func:`scrape` with a Python function, for what Columns cannot express.

    The function gets batches of pages and returns the user columns of ``schema``, one
    row per page in the same order, or None for identity only. Pages that it leaves out
    of a batch are an error, never silently lost.
    """
    identity = scrape(pages, None).schema.fields
    kept = ["doc_id", "type", *METADATA]
    added = [field for field in schema.fields if field.name not in kept]
    marked = pages.drop("doc_id", "type").withColumns({
        "doc_id": document_id(
            F.lit(SCRAPE_KIND), F.col("crawl_tag"), F.col("crawl_timestamp"), F.col("uri"),
            F.col("crawled_at"),
        ),
        "type": F.lit(SCRAPE_KIND),
    })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = function(batch)
            if found is None:
                found = pd.DataFrame(index=range(len(batch)))
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} results for {len(batch)} pages")
            result = batch[kept].reset_index(drop=True)
            for field in added:
                result[field.name] = (
                    found[field.name].to_numpy() if field.name in found else None
                )
            yield result

    return marked.mapInPandas(run, T.StructType([*identity, *added]))


def scrape_run(
    pages: DataFrame, crawl_tag: str, crawl_timestamp: Any,
    columns: Mapping[str, Column] | None,
) -> DataFrame:
    """:func:`scrape` over the pages of one run, which partition pruning selects."""
    run = pages.filter(
        (F.col("crawl_tag") == crawl_tag)
        & (F.col("crawl_timestamp") == instant(crawl_timestamp))
    )
    return scrape(run, columns)
