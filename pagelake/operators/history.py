"""Page versions over time, and key-ordered reads with keyset paging."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions.times import instant
from pagelake.schemas import PAGE_KIND, SCRAPE_KIND
from pagelake.session import written

VERSION = ["crawled_at", "doc_id"]


def page_history(
    pages: DataFrame, crawl_tag: str, uri: str, limit: int | None = None
) -> DataFrame:
    """Versions of one page under a tag, newest first."""
    versions = pages.filter((F.col("crawl_tag") == crawl_tag) & (F.col("uri") == uri))
    ordered = versions.orderBy(*[F.desc(name) for name in VERSION])
    return ordered if limit is None else ordered.limit(limit)


#: Versions up to which the identities of those wanted are broadcast, 16 bytes each.
BROADCAST_ROWS = 2_000_000


def _identity(*names: str) -> list[Column]:
    """128 bits of hash of a row's key."""
    return [F.xxhash64(*names).alias("_h1"), F.xxhash64(F.lit("key"), *names).alias("_h2")]


def _fetched(pages: DataFrame, wanted: DataFrame, extra: list[str]) -> DataFrame:
    """The rows of ``pages`` whose keys are ``wanted``, with its ``extra`` columns.

    Bodies stay where they are as long as the keys are few enough to be broadcast. Beyond
    that the wanted rows are shuffled, and only by a join that first drops most others.
    """
    key = ["uri", "crawl_tag", *VERSION]
    known = written(wanted.select(*_identity(*key), *extra), "versions")
    small = known.count() <= BROADCAST_ROWS
    rows = pages.select("*", *_identity(*key))
    joined = rows.join(known.hint("broadcast" if small else "shuffle_hash"), ["_h1", "_h2"])
    return joined.select(*pages.columns, *extra)


def page_histories(pages: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` versions of every page, numbered from 1.

    Versions are ranked by their keys alone, and the rank filter is applied per task before
    the shuffle, so a page that holds a third of all versions still sends only ``limit``
    rows from each task. Bodies are fetched for the versions that are left.
    """
    newest_first = W.partitionBy("uri", "crawl_tag").orderBy(
        *[F.desc(name) for name in VERSION]
    )
    keys = pages.select("uri", "crawl_tag", *VERSION)
    ranked = keys.withColumn("version", F.row_number().over(newest_first))
    return _fetched(pages, ranked.filter(F.col("version") <= limit), ["version"])


def latest_pages(pages: DataFrame) -> DataFrame:
    """The newest version of every (uri, crawl_tag).

    A combining aggregation of the keys finds it; bodies are fetched for the winners.
    """
    newest = F.max(F.struct(*VERSION)).alias("newest")
    winners = pages.groupBy("uri", "crawl_tag").agg(newest).select("uri", "crawl_tag", "newest.*")
    return _fetched(pages, winners, [])


def latest_page(pages: DataFrame, crawl_tag: str, uri: str) -> DataFrame:
    """Zero or one row."""
    return page_history(pages, crawl_tag, uri, 1)


@dataclass(frozen=True)
class Page:
    """One page of a key-ordered read: its documents, and where the next one starts."""

    documents: DataFrame
    next: DataFrame


def _not_after(keys: list[str], start: dict[str, Any]) -> Column:
    """Rows at or below ``start`` in descending key order; absent keys are unbounded.

    The leading key is also compared alone, which Parquet statistics can use.
    """
    given = [name for name in keys if start.get(name) is not None]
    at_or_below = F.lit(True)
    for name in reversed(given):
        value = F.lit(start[name])
        last = name == given[-1]
        at_or_below = (F.col(name) < value) | (
            (F.col(name) == value) & (F.lit(True) if last else at_or_below)
        )
    if given:
        at_or_below = at_or_below & (F.col(given[0]) <= F.lit(start[given[0]]))
    return at_or_below


def _read_page(
    run: DataFrame, keys: list[str], limit: int | None, start: dict[str, Any]
) -> Page:
    order = [F.desc(name) for name in keys]
    window = run.filter(_not_after(keys, start))
    if limit is None:
        ordered = window.orderBy(*order)
        return Page(ordered, ordered.select(*keys).limit(0))
    # One row beyond the page tells whether there is a next one, and where it starts.
    beyond = window.orderBy(*order).limit(limit + 1)
    numbered = beyond.withColumn("_at", F.row_number().over(W.orderBy(*order)))
    documents = numbered.filter(F.col("_at") <= limit).drop("_at").orderBy(*order)
    cursor = numbered.filter(F.col("_at") > limit).select(*keys)
    return Page(documents, cursor)


def _run(documents: DataFrame, crawl_tag: str, crawl_timestamp: Any) -> DataFrame:
    return documents.filter(
        (F.col("crawl_tag") == crawl_tag)
        & (F.col("crawl_timestamp") == instant(crawl_timestamp))
    )


def run_pages(
    pages: DataFrame, crawl_tag: str, crawl_timestamp: Any, limit: int | None = None,
    start_uri: str | None = None, start_crawled_at: Any = None,
    start_doc_id: Any = None,
) -> Page:
    """Pages of one run in descending (uri, crawled_at, doc_id) order."""
    start = {"uri": start_uri, "crawled_at": start_crawled_at, "doc_id": start_doc_id}
    run = _run(pages, crawl_tag, crawl_timestamp)
    return _read_page(run, ["uri", "crawled_at", "doc_id"], limit, start)


def run_scrape_results(
    results: DataFrame, crawl_tag: str, crawl_timestamp: Any, limit: int | None = None,
    start_uri: str | None = None, start_doc_id: Any = None,
) -> Page:
    """Scrape results of one run in descending (uri, doc_id) order."""
    start = {"uri": start_uri, "doc_id": start_doc_id}
    run = _run(results, crawl_tag, crawl_timestamp)
    return _read_page(run, ["uri", "doc_id"], limit, start)


def view_pages(documents: DataFrame) -> DataFrame:
    """Pages ordered by (uri, tag, instant)."""
    return _view(documents, PAGE_KIND, ["uri", "crawl_tag", "crawled_at"])


def view_page_keys(documents: DataFrame) -> DataFrame:
    """Only the keys of :func:`view_pages`; bodies are never read."""
    keys = ["uri", "crawl_tag", "crawled_at"]
    return documents.filter(F.col("type") == PAGE_KIND).select(*keys).orderBy(*keys)


def view_pages_by_run(documents: DataFrame) -> DataFrame:
    return _view(
        documents, PAGE_KIND, ["crawl_tag", "crawl_timestamp", "uri", "crawled_at"]
    )


def view_by_crawl_date(documents: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Pages ordered by (instant, uri), optionally within [start, end]."""
    within = documents
    if start is not None:
        within = within.filter(F.col("crawled_at") >= instant(start))
    if end is not None:
        within = within.filter(F.col("crawled_at") <= instant(end))
    return _view(within, PAGE_KIND, ["crawled_at", "uri"])


def view_scrape_results(documents: DataFrame) -> DataFrame:
    return _view(documents, SCRAPE_KIND, ["crawl_tag", "crawl_timestamp", "uri"])


def _view(documents: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    return documents.filter(F.col("type") == kind).orderBy(*keys)
