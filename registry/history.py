"""Page history, key-ordered reads, and predicates on stored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import times
from pagelake.operators import history, predicates, scrape, stored_views
from pagelake.plans.crawl import recently_stored, unvisited
from pagelake.schemas import SCRAPE_KIND
from pagelake.sources import store
from registry import shared

QUERIES = {}
ORACLES = {}

NOW = "2024-01-15T12:00:00Z"
RUN_START = "2024-01-08 00:00:00"
PAGE_SIZE = 100


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("h1_page_histories", f"""
WITH {shared.VERSIONS_SQL}
SELECT uri, crawl_tag, version, doc_id, epoch_us(crawled_at) AS crawled_at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY uri, crawl_tag
                               ORDER BY crawled_at DESC, doc_id DESC) AS version
  FROM versions) WHERE version <= 3""")
def h1_page_histories(spark, sf):
    return history.page_histories(shared.versions(spark, sf), 3).select(
        "uri", "crawl_tag", F.col("version").cast("bigint"), "doc_id",
        shared.micros("crawled_at"),
    )


@query("h2_latest_pages", f"""
WITH {shared.VERSIONS_SQL}
SELECT uri, crawl_tag, doc_id, epoch_us(crawled_at) AS crawled_at_us, score, body FROM (
  SELECT *, row_number() OVER (PARTITION BY uri, crawl_tag
                               ORDER BY crawled_at DESC, doc_id DESC) AS version
  FROM versions) WHERE version = 1""")
def h2_latest_pages(spark, sf):
    return history.latest_pages(shared.versions(spark, sf)).select(
        "uri", "crawl_tag", "doc_id", shared.micros("crawled_at"), "score", "body"
    )


def _paged_sql(source: str, order: str) -> str:
    return f"""
SELECT CASE WHEN place <= {PAGE_SIZE} THEN 'page 1' WHEN place <= 2 * {PAGE_SIZE} THEN 'page 2'
            ELSE 'next' END AS part, uri, doc_id
FROM (SELECT uri, doc_id, row_number() OVER (ORDER BY {order}) AS place FROM {source}
      WHERE crawl_tag = 'view' AND crawl_timestamp = TIMESTAMP '{RUN_START}')
WHERE place <= 2 * {PAGE_SIZE} + 1"""


def _two_pages(view: stored_views.StoredView) -> DataFrame:
    """Two pages of a run, from its end, and the cursor behind them, a single row."""
    first = view.page(PAGE_SIZE, descending=True)
    cursor = first.next.first()
    parts = [first.documents.withColumn("part", F.lit("page 1"))]
    if cursor:
        second = view.page(PAGE_SIZE, cursor.asDict(), descending=True)
        parts.append(second.documents.withColumn("part", F.lit("page 2")))
        parts.append(second.next.withColumn("part", F.lit("next")))
    return reduce(
        DataFrame.unionByName, [part.select("part", "uri", "doc_id") for part in parts]
    )


@query("h3_run_pages", f"WITH {shared.VERSIONS_SQL}" + _paged_sql(
    "versions", "uri DESC, crawled_at DESC, doc_id DESC"))
def h3_run_pages(spark, sf):
    run = F.lit(RUN_START).cast("timestamp")
    return _two_pages(stored_views.run_pages(_store(spark, sf), "view", run))


def _results(spark, sf) -> DataFrame:
    """Scrape results of all page versions, keeping the event id as document id."""
    pages = shared.versions(spark, sf)
    scraped = scrape.scrape(
        pages.withColumn("event", F.col("doc_id")),
        {"event": F.col("event"), "k": F.get_json_object("body", "$.k")},
    )
    return scraped.drop("doc_id").withColumnRenamed("event", "doc_id")


@query("h4_run_scrape_results", f"WITH {shared.VERSIONS_SQL}" + _paged_sql(
    "versions", "uri DESC, doc_id DESC"))
def h4_run_scrape_results(spark, sf):
    run = F.lit(RUN_START).cast("timestamp")
    return _two_pages(stored_views.run_scrape_results(_store(spark, sf), "view", run))


def _mixed(spark, sf) -> DataFrame:
    return store.mixed_documents(shared.versions(spark, sf), _results(spark, sf))


def _store(spark, sf) -> DataFrame:
    """All page versions and scrape results as they lie in the store, written once."""
    documents = _mixed(spark, sf)
    path = shared.once(
        spark, sf, "store", lambda target: store.append_documents(documents, target)
    )
    return store.read_documents(spark, path, documents.schema)


@query("h5_view_pages", f"""
WITH {shared.VERSIONS_SQL}
SELECT uri, crawl_tag, epoch_us(crawled_at) AS crawled_at_us, doc_id, body FROM versions""")
def h5_view_pages(spark, sf):
    return stored_views.pages(_store(spark, sf)).rows.select(
        "uri", "crawl_tag", shared.micros("crawled_at"), "doc_id", "body"
    )


@query("h6_view_page_keys", f"""
WITH {shared.VERSIONS_SQL}
SELECT uri, crawl_tag, epoch_us(crawled_at) AS crawled_at_us FROM versions""")
def h6_view_page_keys(spark, sf):
    return stored_views.page_keys(_store(spark, sf)).rows.select(
        "uri", "crawl_tag", shared.micros("crawled_at")
    )


@query("h7_view_pages_by_run", f"""
WITH {shared.VERSIONS_SQL}
SELECT crawl_tag, epoch_us(crawl_timestamp) AS crawl_timestamp_us, uri,
       epoch_us(crawled_at) AS crawled_at_us, doc_id FROM versions""")
def h7_view_pages_by_run(spark, sf):
    return stored_views.pages_by_run(_store(spark, sf)).rows.select(
        "crawl_tag", shared.micros("crawl_timestamp"), "uri", shared.micros("crawled_at"),
        "doc_id",
    )


@query("h8_view_by_crawl_date", f"""
WITH {shared.VERSIONS_SQL}
SELECT epoch_us(crawled_at) AS crawled_at_us, uri, doc_id FROM versions
WHERE crawled_at BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'""")
def h8_view_by_crawl_date(spark, sf):
    between = [
        F.lit(text).cast("timestamp") for text in ("2024-01-05 06:00:00", "2024-01-20 18:00:00")
    ]
    return stored_views.by_crawl_date(_store(spark, sf), *between).rows.select(
        shared.micros("crawled_at"), "uri", "doc_id"
    )


@query("h9_view_scrape_results", f"""
WITH {shared.VERSIONS_SQL}
SELECT crawl_tag, epoch_us(crawl_timestamp) AS crawl_timestamp_us, uri, doc_id,
       json_extract_string(body, '$.k') AS k
FROM versions""")
def h9_view_scrape_results(spark, sf):
    return stored_views.scrape_results(_store(spark, sf)).rows.select(
        "crawl_tag", shared.micros("crawl_timestamp"), "uri", "doc_id", "k"
    )


# --- predicates --------------------------------------------------------------------------

@query("p1_record_kind", f"""
WITH {shared.VERSIONS_SQL}
SELECT 'scrape-result' AS type, uri, doc_id FROM versions""")
def p1_record_kind(spark, sf):
    return store.of_kind(_mixed(spark, sf), SCRAPE_KIND).select("type", "uri", "doc_id")


@query("p3_numeric_range", """
SELECT 'double' AS kind, o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 1000.5 AND 250000.25
UNION ALL SELECT 'long', o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 700
UNION ALL SELECT 'int', c_custkey FROM customer WHERE c_nationkey BETWEEN 3 AND 12
UNION ALL SELECT 'float', event_id FROM events
WHERE CAST(value AS FLOAT) BETWEEN CAST(2.5 AS FLOAT) AND CAST(20.25 AS FLOAT)""")
def p3_numeric_range(spark, sf):
    orders = shared.table(spark, sf, "orders")
    customer = shared.table(spark, sf, "customer")
    events = shared.table(spark, sf, "events")
    checks = [
        (orders, "double", "o_orderkey",
         predicates.numeric_range(F.col("o_totalprice"), 1000.5, 250000.25)),
        (orders, "long", "o_orderkey", predicates.numeric_range(F.col("o_custkey"), 10, 700)),
        (customer, "int", "c_custkey", predicates.numeric_range(F.col("c_nationkey"), 3, 12)),
        (events, "float", "event_id",
         predicates.numeric_range(F.col("value").cast("float"), 2.5, 20.25)),
    ]
    return reduce(DataFrame.unionByName, [
        rows.filter(check).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        for rows, kind, key, check in checks
    ])


@query("p4_date_range", """
SELECT 'order' AS kind, o_orderkey AS id FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1997-06-30 00:00:00'
UNION ALL SELECT 'event', event_id FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 11:30:00'""")
def p4_date_range(spark, sf):
    ordered = predicates.date_range(
        F.col("o_orderdate").cast("timestamp"), "1995-01-01T00:00:00Z", "1997-06-30T02:00:00+02:00"
    )
    crawled = predicates.date_range(
        F.col("ts").cast("timestamp"), "2024-01-10T00:00:00.000Z", "2024-01-12T11:30:00Z"
    )
    orders = shared.table(spark, sf, "orders").filter(ordered)
    events = shared.table(spark, sf, "events").filter(crawled)
    return orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(
        events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    )


@query("p5_boolean_rows", """
SELECT o_orderkey FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 50000.0 AND 300000.0
  AND NOT o_orderpriority = '5-LOW'""")
def p5_boolean_rows(spark, sf):
    combined = predicates.combine(
        predicates.exact_term(F.col("o_orderstatus"), "O"), predicates.MUST,
        predicates.numeric_range(F.col("o_totalprice"), 50000.0, 300000.0), predicates.MUST,
        predicates.exact_term(F.col("o_orderpriority"), "5-LOW"), predicates.MUST_NOT,
        predicates.exact_term(F.col("o_orderpriority"), "1-URGENT"), predicates.SHOULD,
    )
    return shared.table(spark, sf, "orders").filter(combined).select("o_orderkey")


@query("p7_recently_crawled", f"""
WITH {shared.VERSIONS_SQL}
SELECT doc_id, crawled_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 60 MINUTE AS recent
FROM versions""")
def p7_recently_crawled(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return shared.versions(spark, sf).select(
        "doc_id", times.recently_crawled(F.col("crawled_at"), now).alias("recent")
    )


@query("c5_visited_suppression", f"""
WITH {shared.VERSIONS_SQL}
SELECT DISTINCT crawl_tag, uri FROM versions v
WHERE crawled_at >= TIMESTAMP '2024-01-08 00:00:00' AND NOT EXISTS (
  SELECT 1 FROM versions w WHERE w.crawl_tag = v.crawl_tag AND w.uri = v.uri
    AND w.crawled_at < TIMESTAMP '2024-01-08 00:00:00')""")
def c5_visited_suppression(spark, sf):
    """Pages of every tag from the run's start on, without those visited before it."""
    pages = shared.versions(spark, sf)
    before = F.col("crawled_at") < F.lit(RUN_START).cast("timestamp")
    candidates = pages.filter(~before).select("crawl_tag", "uri").distinct()
    visited = pages.filter(before).select("crawl_tag", "uri").distinct()
    return unvisited(candidates, visited, ["crawl_tag", "uri"])


@query("c6_recrawl_suppression", f"""
WITH {shared.VERSIONS_SQL},
known AS (SELECT * FROM versions WHERE crawled_at <= TIMESTAMP '2024-01-15 12:00:00'),
latest AS (SELECT uri, max(crawled_at) AS seen FROM known WHERE crawl_tag = 'view' GROUP BY uri)
SELECT DISTINCT v.uri FROM versions v LEFT JOIN latest USING (uri)
WHERE seen IS NULL OR NOT seen > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 60 MINUTE""")
def c6_recrawl_suppression(spark, sf):
    """All known URIs but those stored under the tag within the hour before now."""
    now = F.lit(NOW).cast("timestamp")
    pages = shared.versions(spark, sf)
    fresh = recently_stored(pages.filter(F.col("crawled_at") <= now), "view", now)
    return unvisited(pages.select("uri").distinct(), fresh)
