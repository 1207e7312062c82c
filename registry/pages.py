"""URL, timestamp, extraction and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import html as html_text
from pagelake.functions import times, urls
from pagelake.operators import links, predicates, schedule, scrape, selectors
from pagelake.operators.links import NumberedStep, Step, numbered_steps
from pagelake.operators.nodes import node_rows, with_nodes
from pagelake.session import new_run_dir
from pagelake.sources import store
from pagelake.sources.snapshot import fetch, snapshot_from_pages
from registry import shared

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# --- sources and sinks -------------------------------------------------------------------

@query("s1_fetch_join", f"""
WITH {shared.SITE_SQL},
frontier AS (SELECT DISTINCT dst FROM edges)
SELECT dst AS uri, uri IS NOT NULL AS fetched,
       CASE WHEN uri IS NOT NULL THEN CAST(200 AS BIGINT) END AS status
FROM frontier LEFT JOIN addressed ON uri = dst""")
def s1_fetch_join(spark, sf):
    """Every link target of the site, fetched or not."""
    snapshot = shared.site_snapshot(spark, sf)
    frontier = links.page_links(snapshot, "uri", "body").select(
        F.col("dst_uri").alias("uri")
    ).distinct()
    return fetch(frontier, snapshot.select("uri", "status")).select(
        "uri", F.col("status").isNotNull().alias("fetched"), F.col("status").cast("bigint")
    )


def _stamped(spark, sf):
    snapshot = snapshot_from_pages(shared.pages(spark, sf))
    return store.stamp_pages(
        snapshot, "pages", F.lit(shared.RUN).cast("timestamp"),
        F.lit(shared.RUN).cast("timestamp"), F.length("body").cast("double"),
    )


@query("s2_bulk_append", r"""
SELECT regexp_replace(url, '#.*$', '') AS uri, 'pages' AS crawl_tag,
       CAST(200 AS BIGINT) AS status, md5(html) AS body_md5
FROM pages""")
def s2_bulk_append(spark, sf):
    """All pages appended to the store and read back."""
    path = new_run_dir(spark, "store")
    pages = _stamped(spark, sf)
    store.append_documents(pages, path)
    stored = store.read_documents(spark, path, pages.schema)
    return stored.select(
        "uri", "crawl_tag", F.col("status").cast("bigint"), F.md5("body").alias("body_md5")
    )


@query("s3_stamp_pages", r"""
SELECT 'crawled-page' AS type, 'pages' AS crawl_tag,
       '2024-01-31T00:00:00.000Z' AS crawl_timestamp,
       '2024-01-31T00:00:00.000Z' AS crawled_at,
       regexp_replace(url, '#.*$', '') AS uri, CAST(length(html) AS DOUBLE) AS score
FROM pages""")
def s3_stamp_pages(spark, sf):
    return store.with_kind(_stamped(spark, sf), "crawled-page").select(
        "type", "crawl_tag", times.to_text(F.col("crawl_timestamp")).alias("crawl_timestamp"),
        times.to_text(F.col("crawled_at")).alias("crawled_at"), "uri", "score",
    )


# --- URLs and timestamps -----------------------------------------------------------------

# Link forms derived from every anchor of every page; {h} is the anchor's own href.
_FORMS = ["{h}", "..{h}", "./x{h}/../y", "sub{h}#part", "?q=1", "#top", "",
          "//other.example{h}", "https://abs.example/a/./b{h}", "mailto:x", "/a b"]

_DOTS = (
    "list_reduce(list_prepend('', string_split(substr({p}, 2), '/')), lambda acc, part: "
    "CASE WHEN part = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
    "WHEN part = '.' THEN acc ELSE acc || '/' || part END)"
)


@query("u1_resolve_url", rf"""
WITH anchors AS (
  SELECT url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h
  FROM pages),
forms AS (
  SELECT base, replace(form, '{{h}}', h) AS link
  FROM anchors, (SELECT unnest({_FORMS!r}) AS form)),
parts AS (
  SELECT base, link, regexp_replace(link, '#.*$', '') AS target,
         regexp_extract(base, '^[a-z]+://[^/]+') AS origin,
         regexp_extract(base, '^([a-z]+:)') AS scheme,
         regexp_replace(regexp_replace(base, '#.*$', ''), '^[a-z]+://[^/]+', '') AS rest
  FROM forms),
split AS (
  SELECT *, regexp_extract(rest, '^[^?]*') AS path,
    CASE WHEN target LIKE 'https://%' THEN regexp_extract(target, '^[a-z]+://[^/]+')
         WHEN target LIKE '//%' THEN scheme || regexp_extract(target, '^//[^/]+')
         ELSE origin END AS new_origin,
    CASE WHEN target LIKE 'https://%' THEN regexp_replace(target, '^[a-z]+://[^/]+', '')
         WHEN target LIKE '//%' THEN regexp_replace(target, '^//[^/]+', '')
         WHEN target LIKE '/%' THEN target
         ELSE regexp_extract(regexp_extract(rest, '^[^?]*'), '^.*/') || target
    END AS raw_path
  FROM parts)
SELECT DISTINCT base, link,
  CASE WHEN target LIKE 'mailto:%' OR target LIKE '% %' THEN NULL
       WHEN target = '' THEN origin || rest
       WHEN target LIKE '?%' THEN origin || path || target
       ELSE new_origin || {_DOTS.format(p='raw_path')} END AS resolved
FROM split""")
def u1_resolve_url(spark, sf):
    """Every anchor of every page in eleven written forms, resolved."""
    found = shared.pages(spark, sf).select(
        F.col("url").alias("base"),
        urls.base_parts(F.col("url")).alias("parts"),
        F.explode(html_text.anchor_hrefs(F.col("html"))).alias("h"),
    )
    forms = F.array(*[
        F.concat(*[
            piece
            for at, text in enumerate(form.split("{h}"))
            for piece in ([F.col("h")] if at else []) + [F.lit(text)]
        ])
        for form in _FORMS
    ])
    return found.select("base", "parts", F.explode(forms).alias("link")).select(
        "base", "link", urls.resolve_against(F.col("parts"), F.col("link")).alias("resolved")
    ).distinct()


@query("u2_uri_segments", r"""
SELECT url AS uri, nullif(regexp_extract(url, '^([^/]+//)([^/]+)(/.*)', 1), '') AS scheme,
       nullif(regexp_extract(url, '^([^/]+//)([^/]+)(/.*)', 2), '') AS host,
       nullif(regexp_extract(url, '^([^/]+//)([^/]+)(/.*)', 3), '') AS path
FROM (SELECT url FROM pages
      UNION ALL SELECT regexp_replace(url, '^([a-z]+://[^/]+)', '\1:8080') FROM pages
      UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]+)') FROM pages)""")
def u2_uri_segments(spark, sf):
    url = F.col("url")
    variants = F.array(
        url,
        F.regexp_replace(url, "^([a-z]+://[^/]+)", "$1:8080"),
        F.regexp_extract(url, "^([a-z]+://[^/]+)", 1),
    )
    spelled = shared.table(spark, sf, "pages").select(F.explode(variants).alias("uri"))
    parts = spelled.select("uri", urls.uri_segments(F.col("uri")).alias("parts"))
    return parts.select("uri", "parts.*")


@query("u3_same_host", f"""
WITH {shared.SITE_SQL}
SELECT src AS src_uri, dst AS dst_uri,
       split_part(src, '/', 3) = split_part(dst, '/', 3) AS same_host
FROM edges GROUP BY src, dst""")
def u3_same_host(spark, sf):
    """All links of the site's pages, to pages of the site and others, told apart by host."""
    found = links.page_links(shared.site(spark, sf), "uri", "body")
    return found.select(
        "src_uri", "dst_uri",
        urls.same_host(F.col("src_uri"), F.col("dst_uri")).alias("same_host"),
    )


_STAMPS_SQL = """
stamps AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS text, epoch_us(ts) // 1000 AS ms
  FROM events
  UNION ALL
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00',
         epoch_ms(date_trunc('second', ts)) - 3600000 FROM events
  UNION ALL SELECT event_id, CAST(event_id AS VARCHAR), NULL FROM events
  UNION ALL SELECT event_id, '', NULL FROM events)"""


def _stamps(spark, sf):
    at = F.col("ts").cast("timestamp")
    texts = F.array(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")),
        F.col("event_id").cast("string"),
        F.lit(""),
    )
    events = shared.table(spark, sf, "events")
    return events.select("event_id", F.explode(texts).alias("text"))


@query("u4_rfc3339_to_millis", f"""
WITH {_STAMPS_SQL} SELECT event_id, text, ms FROM stamps""")
def u4_rfc3339_to_millis(spark, sf):
    return _stamps(spark, sf).withColumn("ms", times.to_millis(F.col("text")))


@query("u5_rfc3339_in_zone", f"""
WITH {_STAMPS_SQL},
zoned AS (
  SELECT event_id, text, ms,
         make_timestamp(ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS t
  FROM stamps)
SELECT event_id, text, day(t) AS day, hour(t) AS hour, minute(t) AS minute,
       second(t) AS second
FROM zoned""")
def u5_rfc3339_in_zone(spark, sf):
    local = _stamps(spark, sf).withColumn(
        "t", times.in_zone(F.col("text"), "America/New_York")
    )
    return local.select(
        "event_id", "text",
        *[
            part("t").cast("bigint").alias(part.__name__.replace("dayofmonth", "day"))
            for part in (F.dayofmonth, F.hour, F.minute, F.second)
        ],
    )


@query("u6_is_html", r"""
SELECT url AS uri, url LIKE '%.html' AS is_html FROM pages""")
def u6_is_html(spark, sf):
    """Headers by kind of address: HTML, plain text, or none at all."""
    kind = F.when(F.col("url").endswith(".html"), "text/html;charset=UTF-8").when(
        F.col("url").endswith("/"), "text/plain;charset=UTF-8"
    )
    headers = F.when(kind.isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("content-type"), kind)
    )
    return shared.table(spark, sf, "pages").select(
        F.col("url").alias("uri"), urls.is_html(headers).alias("is_html")
    )


# --- extraction --------------------------------------------------------------------------

_PAGE_LINKS_SQL = r"""
links AS (
  SELECT DISTINCT url AS src_uri, regexp_extract(url, '^[a-z]+://[^/]+') || h AS dst_uri
  FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h
        FROM pages))"""


@query("x1_page_links", f"WITH {_PAGE_LINKS_SQL} SELECT src_uri, dst_uri FROM links")
def x1_page_links(spark, sf):
    return links.page_links(shared.pages(spark, sf))


@query("x2_selector_links", f"WITH {_PAGE_LINKS_SQL} SELECT src_uri, dst_uri FROM links")
def x2_selector_links(spark, sf):
    """The raw pages have anchors in their navigation only, so both ways agree."""
    parsed = with_nodes(shared.pages(spark, sf).select("url", "html"))
    return links.selector_links(parsed, "nav ul a")


@query("x3_filtered_links", rf"""
WITH {_PAGE_LINKS_SQL}
SELECT src_uri, dst_uri FROM links
WHERE regexp_full_match(dst_uri, 'https://.*')
  AND regexp_full_match(regexp_extract(dst_uri, '^[^/]+//[^/]+(/.*)', 1), '/th.*|/l[ae]s?')""")
def x3_filtered_links(spark, sf):
    parsed = with_nodes(shared.pages(spark, sf).select("url", "html"))
    return links.selector_links(parsed, "nav a", "https://.*", "/th.*|/l[ae]s?")


_STEPS = [
    Step("ul#menu a", path_filter="/(en|fr)/.+", next=(Step("div#content a"),)),
    Step("div#content a", filter=r"http://example\.com/.*"),
]

_STEP_LINKS_SQL = rf"""
WITH {shared.SITE_SQL},
own AS (SELECT DISTINCT src, dst, menu FROM edges WHERE menu >= 0)
SELECT src AS src_uri, dst AS dst_uri, CAST(1 AS BIGINT) AS step_id, CAST(0 AS BIGINT) AS ord
FROM own WHERE menu = 1
  AND regexp_full_match(regexp_extract(dst, '^[^/]+//[^/]+(/.*)', 1), '/(en|fr)/.+')
"""


def _found_by(spark, sf, steps: list[NumberedStep]):
    parsed = with_nodes(shared.site(spark, sf).select("uri", "body"), "body")
    return links.step_links(parsed, steps, uri="uri").select(
        "src_uri", "dst_uri", F.col("step_id").cast("bigint"), F.col("ord").cast("bigint")
    )


@query("x4_links_for_step", _STEP_LINKS_SQL)
def x4_links_for_step(spark, sf):
    """Links of one step, each tagged with it."""
    return _found_by(spark, sf, numbered_steps(_STEPS)[:1])


@query("x5_links_for_all_steps", _STEP_LINKS_SQL + r"""
UNION ALL
SELECT src, dst, 2, 1 FROM own
WHERE menu = 0 AND regexp_full_match(dst, 'http://example\.com/.*')""")
def x5_links_for_all_steps(spark, sf):
    """Links of all top-level steps; one found twice appears twice."""
    top = [entry for entry in numbered_steps(_STEPS) if entry.parent_step_id == links.ROOT_STEP]
    return _found_by(spark, sf, top)


_BLOCKS_SQL = "html|head|meta|title|body|nav|ul|li|div|article|h1|p|br|footer"

_TEXT_SQL = rf"""trim(regexp_replace(regexp_replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
    '(?i)</?(?:{_BLOCKS_SQL})\b[^>]*>', ' ', 'g'),
    '<[/!?a-zA-Z][^>]*>', '', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp(;|\b)', '&', 'g'), '\s+', ' ', 'g'))"""

_H1_SQL = r"""regexp_replace(
  replace(regexp_extract(html, '<{t}>(.*?)</{t}>', 1), '&quot;', '"'),
  '&amp(;|\b)', '&', 'g')"""


@query("x6_plaintext", f"SELECT page_id, {_TEXT_SQL} AS fulltext FROM pages")
def x6_plaintext(spark, sf):
    return shared.pages(spark, sf).select(
        "page_id", html_text.plaintext(F.col("html")).alias("fulltext")
    )


@query("x7_page_nodes", r"""
WITH tags AS (
  SELECT page_id, unnest(regexp_extract_all(
    regexp_replace(html, '(?s)<!--.*?-->|>var t=.*?</script>', '', 'g'),
    '<([a-z][a-z0-9]*)\b', 1)) AS tag
  FROM pages)
SELECT page_id, tag, count(*) AS n_nodes FROM tags GROUP BY page_id, tag""")
def x7_page_nodes(spark, sf):
    """Elements per page and tag, from the parsed node table."""
    parsed = with_nodes(shared.pages(spark, sf).select("page_id", "html"))
    return node_rows(parsed, "page_id").groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("n_nodes")
    )


@query("x8_selector_match", r"""
WITH anchors AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(len(h) AS BIGINT) AS n_menu_links, h[2] AS second_href,
       CAST(1 AS BIGINT) AS n_ads
FROM anchors""")
def x8_selector_match(spark, sf):
    """Descendant, nth-of-type and class selectors on every page."""
    parsed = with_nodes(shared.pages(spark, sf).select("page_id", "html"))
    nodes = F.col("nodes")
    return parsed.select(
        "page_id",
        F.size(selectors.select_nodes(nodes, "nav ul li a")).cast("bigint").alias("n_menu_links"),
        selectors.first_or_null(
            selectors.hrefs(nodes, "nav li:nth-of-type(2) a")
        ).alias("second_href"),
        F.size(selectors.select_nodes(nodes, "body div.ad")).cast("bigint").alias("n_ads"),
    )


@query("x9_trimmed_content", f"""
SELECT page_id, trim({_H1_SQL.format(t='title')}) AS title,
       trim({_H1_SQL.format(t='h1')}) AS heading,
       CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items
FROM pages""")
def x9_trimmed_content(spark, sf):
    parsed = with_nodes(shared.pages(spark, sf).select("page_id", "html"))
    nodes = F.col("nodes")
    return parsed.select(
        "page_id",
        selectors.first_or_null(selectors.trimmed_content(nodes, "title")).alias("title"),
        selectors.first_or_null(
            selectors.trimmed_content(nodes, "article h1")
        ).alias("heading"),
        F.size(selectors.trimmed_content(nodes, "nav li")).cast("bigint").alias("n_items"),
    )


_SCRAPE_SQL = rf"""
SELECT 'scrape-result' AS type, regexp_replace(url, '#.*$', '') AS uri,
       'pages' AS crawl_tag, trim({_H1_SQL.format(t='title')}) AS title,
       md5({_TEXT_SQL}) AS fulltext_md5
FROM pages"""


def _scraping_columns():
    body = F.col("body")
    return {
        "title": html_text.title(body),
        "fulltext_md5": F.md5(html_text.plaintext(body)),
        "crawl_tag": F.lit("user columns never replace identity"),
    }


@query("x10_scrape_job", _SCRAPE_SQL)
def x10_scrape_job(spark, sf):
    """Every page of a run scraped, stored, and read back."""
    results = scrape.scrape_run(
        _stamped(spark, sf), "pages", F.lit(shared.RUN).cast("timestamp"),
        _scraping_columns(),
    )
    path = new_run_dir(spark, "results")
    store.replace_run(results, path)
    return store.read_documents(spark, path, results.schema).select(
        "type", "uri", "crawl_tag", "title", "fulltext_md5"
    )


# --- link graph, checks and pacing -------------------------------------------------------

@query("p8_link_filter", rf"""
WITH {_PAGE_LINKS_SQL}
SELECT src_uri, dst_uri FROM links WHERE regexp_full_match(dst_uri, 'http://[^/]*\.org/.*')""")
def p8_link_filter(spark, sf):
    found = links.page_links(shared.pages(spark, sf))
    allowed = urls.full_match(F.col("dst_uri"), r"http://[^/]*\.org/.*")
    return found.filter(predicates.link_allowed(F.col("dst_uri"), allowed))


@query("c9_link_graph", f"""
WITH {shared.SITE_SQL},
links AS (SELECT DISTINCT src, dst FROM edges),
ends AS (SELECT src AS uri, 1 AS o, 0 AS i FROM links
         UNION ALL SELECT dst, 0, 1 FROM links)
SELECT uri, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree
FROM ends GROUP BY uri""")
def c9_link_graph(spark, sf):
    return links.link_degrees(links.page_links(shared.site(spark, sf), "uri", "body"))


@query("c7_fetch_schedule", r"""
SELECT page_id, regexp_extract(url, '^[^/]+//([^/]+)/', 1) AS host,
       epoch_us(TIMESTAMP '2024-01-31 00:00:00') + 1500000 * (row_number() OVER (
         PARTITION BY regexp_extract(url, '^[^/]+//([^/]+)/', 1) ORDER BY page_id) - 1)
         AS fetch_at_us
FROM pages""")
def c7_fetch_schedule(spark, sf):
    requests = shared.table(spark, sf, "pages").select(
        "page_id", urls.host(F.col("url")).alias("host")
    )
    planned = schedule.fetch_schedule(requests, shared.RUN, 1500, order=["page_id"])
    return planned.select("page_id", "host", shared.micros("fetch_at"))


@query("c8_politeness_audit", f"""
WITH {shared.VERSIONS_SQL},
gaps AS (
  SELECT doc_id, crawl_tag AS host, epoch_us(crawled_at) - lag(epoch_us(crawled_at)) OVER (
    PARTITION BY crawl_tag ORDER BY crawled_at, doc_id) AS gap_us
  FROM versions)
SELECT doc_id, host, gap_us, coalesce(gap_us > 600000 * 1000, true) AS polite FROM gaps""")
def c8_politeness_audit(spark, sf):
    fetched = shared.versions(spark, sf).select(
        "doc_id", F.col("crawl_tag").alias("host"), "crawled_at"
    )
    audited = schedule.politeness_audit(fetched, 600_000)
    return audited.select("doc_id", "host", "gap_us", "polite")
