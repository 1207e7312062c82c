"""Crawls over the linked site, and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.operators import scrape
from pagelake.operators.links import Step
from pagelake.plans.crawl import directed_crawl, weighted_crawl
from pagelake.session import new_run_dir
from pagelake.sources import store
from pagelake.streaming import incremental
from registry import pages as page_queries
from registry import shared

QUERIES = {}
ORACLES = {}

MAX_DEPTH = 2


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# --- directed crawl ----------------------------------------------------------------------

_STEPS = [
    Step("ul#menu a", path_filter=r"/(en|fr|de)/.+", next=(
        Step("div#content a", next=(Step("ul#menu a"),)),
    )),
    Step("div#content a", filter=r"http://example\.(com|net)/.*"),
]

_DIRECTED_SQL = rf"""
WITH {shared.SITE_SQL},
own AS (SELECT DISTINCT src, dst, menu FROM edges WHERE menu >= 0),
l0 AS (SELECT uri, 0 AS step_id, [struct_pack(o := 0, u := uri)] AS place
       FROM addressed WHERE regexp_matches(uri, '/es/')),
f1 AS (
  SELECT dst AS uri, CASE WHEN menu = 1 THEN 1 ELSE 2 END AS step_id,
    list_append(place, struct_pack(o := CASE WHEN menu = 1 THEN 0 ELSE 1 END, u := dst)) AS place
  FROM l0 JOIN own ON src = uri
  WHERE (menu = 1 AND regexp_full_match(dst, 'http://[^/]+/(en|fr|de)/.+'))
     OR (menu = 0 AND regexp_full_match(dst, 'http://example\.(com|net)/.*'))),
l1 AS (
  SELECT uri, step_id, place FROM (
    SELECT *, row_number() OVER (PARTITION BY uri ORDER BY place) AS rn FROM f1)
  WHERE rn = 1 AND uri NOT IN (SELECT uri FROM l0)),
f2 AS (
  SELECT dst AS uri, 3 AS step_id, list_append(place, struct_pack(o := 0, u := dst)) AS place
  FROM l1 JOIN own ON src = uri WHERE step_id = 1 AND menu = 0),
l2 AS (
  SELECT uri, step_id, place FROM (
    SELECT *, row_number() OVER (PARTITION BY uri ORDER BY place) AS rn FROM f2)
  WHERE rn = 1 AND uri NOT IN (SELECT uri FROM l0 UNION ALL SELECT uri FROM l1)),
f3 AS (SELECT DISTINCT dst AS uri, 4 AS step_id FROM l2 JOIN own ON src = uri WHERE menu = 1),
l3 AS (
  SELECT uri, step_id FROM f3 WHERE uri NOT IN (
    SELECT uri FROM l0 UNION ALL SELECT uri FROM l1 UNION ALL SELECT uri FROM l2)),
reached AS (
  SELECT uri, step_id, 0 AS level FROM l0 UNION ALL SELECT uri, step_id, 1 FROM l1
  UNION ALL SELECT uri, step_id, 2 FROM l2 UNION ALL SELECT uri, step_id, 3 FROM l3)
SELECT uri, CAST(step_id AS BIGINT) AS step_id, CAST(level AS BIGINT) AS level,
       CAST(200 AS BIGINT) AS status, 'directed' AS crawl_tag
FROM reached"""


@query("c1_directed_crawl", _DIRECTED_SQL)
def c1_directed_crawl(spark, sf):
    """From all Spanish pages along a three-level step tree."""
    snapshot = shared.site_snapshot(spark, sf)
    seeds = snapshot.filter(F.col("uri").contains("/es/")).select("uri")
    run = F.lit(shared.RUN).cast("timestamp")
    crawled = directed_crawl(snapshot, seeds, _STEPS, "directed", run, run)
    return crawled.select(
        "uri", F.col("step_id").cast("bigint"), F.col("level").cast("bigint"),
        F.col("status").cast("bigint"), "crawl_tag",
    )


# --- weighted crawl ----------------------------------------------------------------------

# The body's own start adds one paragraph to those of the raw page.
_WEIGHTED_SQL = rf"""
WITH RECURSIVE {shared.SITE_SQL.strip()},
scores AS (
  SELECT uri, len(regexp_extract_all(html, '<p>')) + 1 - 5 AS base FROM addressed),
attempted(uri, depth, level) USING KEY (uri) AS (
  SELECT uri, 0, 0 FROM addressed WHERE page_id = 0
  UNION ALL
  SELECT dst, min(CASE WHEN split_part(src, '/', 3) = split_part(dst, '/', 3)
                       THEN depth + 1 ELSE 0 END), any_value(level) + 1
  FROM attempted JOIN scores USING (uri) JOIN edges ON src = uri
  WHERE base - depth >= 0 AND depth < {MAX_DEPTH}
    AND NOT regexp_full_match(dst, '.*/[^/]*ü[^/]*')
    AND NOT EXISTS (SELECT 1 FROM recurring.attempted r WHERE r.uri = dst)
  GROUP BY dst),
scored AS (
  SELECT a.uri, a.depth, a.level, CAST(base - depth AS DOUBLE) AS score
  FROM attempted a JOIN scores USING (uri))"""


def _weighted(spark, sf):
    """One crawl from page 0; pages score by their paragraphs less their depth."""
    snapshot = shared.site_snapshot(spark, sf)
    seed = shared.site(spark, sf).filter(F.col("page_id") == 0).select("uri")
    run = F.lit(shared.RUN).cast("timestamp")
    return weighted_crawl(
        snapshot, seed, MAX_DEPTH,
        score=F.col("paragraphs") - 5 - F.col("depth"),
        features={"paragraphs": F.regexp_count("body", F.lit("<p>"))},
        link_filter=lambda uri: ~urls.full_match(uri, ".*/[^/]*ü[^/]*"),
        crawl_tag="weighted", crawl_timestamp=run, now=run,
    )


def _crawl_tables(spark, sf):
    """The crawl's three results, written once and read by several queries."""
    def build(path):
        crawl = _weighted(spark, sf)
        crawl.stored.drop("trace_redirects", "headers").write.parquet(f"{path}/stored")
        crawl.attempted.write.parquet(f"{path}/attempted")
        crawl.scored.write.parquet(f"{path}/scored")

    path = shared.once(spark, sf, "weighted-crawl", build)
    return [spark.read.parquet(f"{path}/{name}") for name in ("stored", "attempted", "scored")]


@query("c2_weighted_crawl", _WEIGHTED_SQL + """
SELECT uri, CAST(depth AS BIGINT) AS depth, CAST(level AS BIGINT) AS level, score,
       'weighted' AS crawl_tag
FROM scored WHERE score > 0""")
def c2_weighted_crawl(spark, sf):
    stored = _crawl_tables(spark, sf)[0]
    return stored.select(
        "uri", F.col("depth").cast("bigint"), F.col("level").cast("bigint"), "score",
        "crawl_tag",
    )


@query("c3_relevance", _WEIGHTED_SQL + """
SELECT uri, CASE WHEN score > 0 THEN 'store' WHEN score = 0 THEN 'follow' ELSE 'ignore' END
       AS relevance
FROM scored""")
def c3_relevance(spark, sf):
    return _crawl_tables(spark, sf)[2].select("uri", "relevance")


@query("c4_host_hops", _WEIGHTED_SQL + """
SELECT uri, CAST(depth AS BIGINT) AS depth, CAST(level AS BIGINT) AS level,
       split_part(uri, '/', 3) AS host
FROM attempted""")
def c4_host_hops(spark, sf):
    """Every attempted URI with the depth it was reached at, failed fetches included."""
    attempted = _crawl_tables(spark, sf)[1]
    return attempted.select(
        "uri", F.col("depth").cast("bigint"), F.col("level").cast("bigint"),
        urls.host(F.col("uri")).alias("host"),
    )


# --- streaming ---------------------------------------------------------------------------

@query("t1_scrape_stream", page_queries._SCRAPE_SQL)
def t1_scrape_stream(spark, sf):
    """The scrape job of x10 over pages as they arrive."""
    arriving = new_run_dir(spark, "arriving")
    stamped = page_queries._stamped(spark, sf)
    store.append_documents(stamped, arriving)
    stream = incremental.stream_table(spark, arriving, stamped.schema, files_per_trigger=4)
    path, checkpoint = new_run_dir(spark, "results"), new_run_dir(spark, "checkpoint")
    columns = page_queries._scraping_columns()
    incremental.scrape_stream(stream, columns, path, checkpoint).awaitTermination()
    results = scrape.scrape(stamped, columns)
    return store.read_documents(spark, path, results.schema).select(
        "type", "uri", "crawl_tag", "title", "fulltext_md5"
    )


@query("t2_recrawl_stream", f"""
WITH RECURSIVE {shared.VERSIONS_SQL},
accepted AS (
  SELECT crawl_tag, uri, min(crawled_at) AS moment FROM versions GROUP BY crawl_tag, uri
  UNION ALL
  SELECT v.crawl_tag, v.uri, min(v.crawled_at) FROM accepted a JOIN versions v
    ON v.crawl_tag = a.crawl_tag AND v.uri = a.uri AND v.crawled_at >= a.moment + INTERVAL 60 MINUTE
  GROUP BY v.crawl_tag, v.uri)
SELECT crawl_tag, uri, epoch_us(moment) AS crawled_at_us FROM accepted""")
def t2_recrawl_stream(spark, sf):
    """All requests, arriving in four files, each one batch; the files follow in time."""
    requests = shared.versions(spark, sf).select("doc_id", "uri", "crawl_tag", "crawled_at")
    arriving = new_run_dir(spark, "requests")
    at = F.unix_micros("crawled_at")
    low, high = requests.agg(F.min(at), F.max(at)).first()
    part = F.least(F.lit(3), F.floor((at - low) * 4 / (high - low + 1)))
    for number in range(4):
        requests.filter(part == number).coalesce(1).write.mode("append").parquet(arriving)
    stream = incremental.stream_table(spark, arriving, requests.schema, files_per_trigger=1)
    path, checkpoint = new_run_dir(spark, "passed"), new_run_dir(spark, "checkpoint")
    incremental.suppress_recrawls(stream, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select(
        "uri", "crawl_tag", shared.micros("crawled_at")
    )
