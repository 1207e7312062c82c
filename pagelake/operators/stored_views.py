"""Ordered views over the page store, read page by page without sorting the store.

The store's files hold ranges of runs and URIs. A view keeps one row per file: the range
of the view's leading keys in it, and its number of rows. A page of the view is then a
bounded scan: the files next to where it starts that hold enough rows give the bound at
which reading can end, and both ends reach the scan as filters on partitions and columns.
Only the rows between them are sorted, for one page at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions.times import instant
from pagelake.operators.history import Page
from pagelake.schemas import PAGE_KIND, SCRAPE_KIND
from pagelake.session import written


def _beyond(keys: list[str], start: dict[str, Any], down: bool) -> Column:
    """Rows at ``start`` or after it in key order; keys that are absent are open.

    Each key is also compared alone as long as those before it are fixed: the leading ones
    can prune partitions and row groups.
    """
    given = []
    for name in keys:
        if start.get(name) is None:
            break
        given.append(name)
    at_or_after = F.lit(True)
    for name in reversed(given):
        value = F.lit(start[name])
        after = F.col(name) < value if down else F.col(name) > value
        at_or_after = after | ((F.col(name) == value) & at_or_after)
    if given:
        lead = F.lit(start[given[0]])
        at_or_after = at_or_after & (F.col(given[0]) <= lead if down else F.col(given[0]) >= lead)
    return at_or_after


@dataclass(frozen=True)
class StoredView:
    """``rows`` of the store in the order of ``keys``; ``ranges`` of the first keys by file."""

    rows: DataFrame
    keys: tuple[str, ...]
    lead: tuple[str, ...]
    ranges: DataFrame

    def page(
        self, limit: int, start: dict[str, Any] | None = None, descending: bool = False
    ) -> Page:
        """``limit`` rows from ``start`` on, in order, and the key behind them."""
        keys, start = list(self.keys), start or {}
        order = [F.desc(name) if descending else F.asc(name) for name in keys]
        numbered = self._near(limit + 1, start, descending).orderBy(*order).limit(
            limit + 1
        ).withColumn("_at", F.row_number().over(W.orderBy(*order)))
        documents = numbered.filter(F.col("_at") <= limit).drop("_at").orderBy(*order)
        return Page(documents, numbered.filter(F.col("_at") > limit).select(*keys))

    def _near(self, count: int, start: dict[str, Any], down: bool) -> DataFrame:
        """The rows from ``start`` to where at least ``count`` rows are certain."""
        near, far = ("high", "low") if down else ("low", "high")
        lead = list(self.lead)
        ends = self.ranges.select("n", F.col(far), *[F.col(near)[name].alias(name) for name in lead])
        # One row per file, of which those that lie behind the start as a whole count.
        upwards = W.orderBy(F.desc(far) if down else F.asc(far)).rowsBetween(
            W.unboundedPreceding, W.currentRow
        )
        strict = {name: start[name] for name in lead if start.get(name) is not None}
        enough = (
            ends.filter(_beyond(lead, strict, down)).withColumn("sum", F.sum("n").over(upwards))
            .filter(F.col("sum") >= count + self._on_start(strict, down))
            .orderBy("sum").select(f"{far}.*").first()
        )
        rows = self.rows.filter(_beyond(list(self.keys), start, down))
        if enough is None:
            return rows
        return rows.filter(_beyond(lead, enough.asDict(), not down))

    def _on_start(self, strict: dict[str, Any], down: bool) -> int:
        """Rows of files behind the start that may share its leading keys, yet precede it."""
        if not strict:
            return 0
        same = F.lit(True)
        for name, value in strict.items():
            same = same & (F.col("high" if down else "low")[name] == F.lit(value))
        return self.ranges.filter(same).agg(F.sum("n")).first()[0] or 0


def stored_view(rows: DataFrame, keys: list[str], lead: int = 1) -> StoredView:
    """A view of ``rows``, which are read from the store, ordered by ``keys``.

    The ranges of the first ``lead`` keys are gathered once, from those columns alone.
    Documents without these keys are not in the view.
    """
    first = keys[:lead]
    known = rows.filter(" AND ".join(f"{name} IS NOT NULL" for name in first))
    ranges = known.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(F.struct(*first)).alias("low"), F.max(F.struct(*first)).alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    return StoredView(known, tuple(keys), tuple(first), written(ranges, "ranges"))


def _of_kind(documents: DataFrame, kind: str) -> DataFrame:
    return documents.filter(F.col("type") == kind)


def _of_run(documents: DataFrame, crawl_tag: str, crawl_timestamp: Any) -> DataFrame:
    return documents.filter(
        (F.col("crawl_tag") == crawl_tag) & (F.col("crawl_timestamp") == instant(crawl_timestamp))
    )


def run_pages(documents: DataFrame, crawl_tag: str, crawl_timestamp: Any) -> StoredView:
    """Pages of one run by (uri, instant, id); only its partition is listed and read."""
    run = _of_run(_of_kind(documents, PAGE_KIND), crawl_tag, crawl_timestamp)
    return stored_view(run, ["uri", "crawled_at", "doc_id"])


def run_scrape_results(documents: DataFrame, crawl_tag: str, crawl_timestamp: Any) -> StoredView:
    """Scrape results of one run by (uri, id)."""
    run = _of_run(_of_kind(documents, SCRAPE_KIND), crawl_tag, crawl_timestamp)
    return stored_view(run, ["uri", "doc_id"])


def pages(documents: DataFrame) -> StoredView:
    """Pages by (uri, tag, instant)."""
    return stored_view(_of_kind(documents, PAGE_KIND), ["uri", "crawl_tag", "crawled_at", "doc_id"])


def page_keys(documents: DataFrame) -> StoredView:
    """The keys of :func:`pages`; other columns are never read."""
    view = pages(documents)
    return StoredView(view.rows.select(*view.keys), view.keys, view.lead, view.ranges)


def pages_by_run(documents: DataFrame) -> StoredView:
    """Pages by (tag, run, uri, instant)."""
    return stored_view(
        _of_kind(documents, PAGE_KIND),
        ["crawl_tag", "crawl_timestamp", "uri", "crawled_at", "doc_id"], lead=3,
    )


def by_crawl_date(documents: DataFrame, start: Any = None, end: Any = None) -> StoredView:
    """Pages by (instant, uri), optionally within [start, end]."""
    within = _of_kind(documents, PAGE_KIND)
    if start is not None:
        within = within.filter(F.col("crawled_at") >= instant(start))
    if end is not None:
        within = within.filter(F.col("crawled_at") <= instant(end))
    return stored_view(within, ["crawled_at", "uri", "doc_id"])


def scrape_results(documents: DataFrame) -> StoredView:
    """Scrape results by (tag, run, uri)."""
    return stored_view(
        _of_kind(documents, SCRAPE_KIND), ["crawl_tag", "crawl_timestamp", "uri", "doc_id"], lead=3
    )
