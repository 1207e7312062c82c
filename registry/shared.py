"""Inputs the registered queries have in common, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.fuzzy import with_neighbours
from pagelake.operators.index import Index, IndexField
from pagelake.session import new_run_dir, stored_bytes
from pagelake.sources.index_files import CREATE, add_documents, read_index
from pagelake.sources.tables import read_text_table

RUN = "2024-01-31T00:00:00Z"


_built: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf: str, label: str, build) -> str:
    """Path of a table that several queries read, built at first use per application."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _built:
        path = new_run_dir(spark, label)
        build(path)
        _built[key] = path
    return _built[key]


#: Set by those who run the queries over files that cannot be split.
SPREAD_SETTING = "pagelake.spread"


#: Bytes of a table's files that one task analyses.
BYTES_PER_TASK = 8 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(spark: SparkSession) -> int | None:
    """Partitions for tables whose files have one row group each, if the session asks."""
    wanted = spark.conf.get(SPREAD_SETTING, None)
    return int(wanted) if wanted else None


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_text_table(spark, f"{sf}/pages.parquet", "page_id", _spread(spark))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are analysed word by word, which costs far more than to deal them out; a file
    of one row group would be analysed, and its postings counted, by a single task. Tasks
    follow the bytes, so that none grows with the table."""
    path = f"{sf}/documents.parquet"
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-stored_bytes(spark, path) // BYTES_PER_TASK),
    )
    return read_text_table(spark, path, "doc_id", _spread(spark) or parts)


# --- page versions: events stand in for the store --------------------------------------

def versions(spark: SparkSession, sf: str) -> DataFrame:
    """events as crawled pages: user as URI, event type as tag, week as run."""
    events = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("doc_id"),
        F.col("event_type").alias("crawl_tag"),
        F.date_trunc("week", at).alias("crawl_timestamp"),
        F.format_string("http://example.com/u%d", "user_id").alias("uri"),
        at.alias("crawled_at"),
        F.col("value").alias("score"),
        F.col("props").alias("body"),
    )


VERSIONS_SQL = """
versions AS (
  SELECT event_id AS doc_id, event_type AS crawl_tag,
         CAST(date_trunc('week', ts) AS TIMESTAMP) AS crawl_timestamp,
         'http://example.com/u' || user_id AS uri, ts AS crawled_at,
         value AS score, props AS body
  FROM events)"""


def micros(name: str, alias: str | None = None):
    """An instant as epoch microseconds, which both engines print alike."""
    return F.unix_micros(F.col(name)).alias(alias or f"{name}_us")


# --- a site to crawl: pages with links to each other -----------------------------------

def site(spark: SparkSession, sf: str) -> DataFrame:
    """pages as a linked site (page_id, uri, body), derived once per application."""
    path = once(
        spark, sf, "site", lambda target: _derive_site(spark, sf).write.parquet(target)
    )
    return read_text_table(spark, path, "page_id", _spread(spark))


def _derive_site(spark: SparkSession, sf: str) -> DataFrame:
    """pages with links to each other.

    No link of the raw pages leads to another page, so each page i gets a menu link to
    page 2i+1 and content links to pages 2i+2 and i div 2 in front of its own HTML. The
    address keeps the page's domain, which gives three hosts.
    """
    raw = pages(spark, sf)
    addressed = raw.select(
        "page_id",
        F.concat(
            F.lit("http://"),
            F.regexp_extract("url", r"(example\.[a-z]+)", 1),
            F.lit("/"),
            F.regexp_extract("url", r"/(en|fr|de|es)/", 1),
            F.lit("/"),
            F.col("page_id").cast("string"),
            F.lit(".html"),
        ).alias("uri"),
    )

    def target(alias: str) -> DataFrame:
        return addressed.select(
            F.col("page_id").alias(f"{alias}_id"), F.col("uri").alias(alias)
        )

    linked = (
        addressed.join(target("menu"), F.col("menu_id") == 2 * F.col("page_id") + 1, "left")
        .join(target("content"), F.col("content_id") == 2 * F.col("page_id") + 2, "left")
        .join(target("back"), F.col("back_id") == F.floor(F.col("page_id") / 2), "left")
    )

    def anchor(name: str):
        markup = F.concat(F.lit('<a href="'), F.col(name), F.lit('">go</a>'))
        return F.coalesce(markup, F.lit(""))

    return linked.join(raw.select("page_id", "html"), "page_id").select(
        "page_id",
        "uri",
        F.concat(
            F.lit('<ul id="menu"><li>'), anchor("menu"),
            F.lit('</li></ul><div id="content"><p>'), anchor("content"), anchor("back"),
            F.lit("</p></div>"), F.col("html"),
        ).alias("body"),
    )


def site_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return site(spark, sf).select(
        "uri",
        F.array("uri").alias("trace_redirects"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html;charset=UTF-8")).alias("headers"),
        "body",
    )


SITE_SQL = r"""
addressed AS (
  SELECT page_id, html, 'http://' || regexp_extract(url, '(example\.[a-z]+)', 1) AS origin,
         'http://' || regexp_extract(url, '(example\.[a-z]+)', 1) || '/' ||
         regexp_extract(url, '/(en|fr|de|es)/', 1) || '/' || page_id || '.html' AS uri
  FROM pages),
edges AS (
  SELECT a.uri AS src, b.uri AS dst, 1 AS menu
  FROM addressed a JOIN addressed b ON b.page_id = 2 * a.page_id + 1
  UNION ALL
  SELECT a.uri, b.uri, 0 FROM addressed a
  JOIN addressed b ON b.page_id = 2 * a.page_id + 2 OR b.page_id = a.page_id // 2
  UNION ALL
  SELECT uri, origin || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), -1
  FROM addressed)"""


# --- the document index ------------------------------------------------------------------

DOCUMENT_FIELDS = [
    IndexField("text", indexed=True, tokenized=True),
    IndexField("lang", indexed=True, stored=True),
    IndexField("source", indexed=True, stored=True),
    IndexField("n_chars", "long", indexed=True, stored=True),
]

def document_index(spark: SparkSession, sf: str) -> Index:
    """The index over all documents; search queries share one build."""
    path = once(
        spark, sf, "documents-index",
        lambda target: add_documents(
            documents(spark, sf), "doc_id", DOCUMENT_FIELDS, target, CREATE
        ),
    )
    return read_index(spark, path)


_fuzzy: dict[tuple[str, str], Index] = {}


def fuzzy_index(spark: SparkSession, sf: str) -> Index:
    """The document index with the neighbourhoods of its terms, built once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fuzzy:
        _fuzzy[key] = with_neighbours(document_index(spark, sf))
    return _fuzzy[key]


WORD_SQL = r"(?:\p{L}+(?:[''’.:·]\p{L}+)*|\p{N}+(?:[''’.,;]\p{N}+)*|[\p{M}_]+)+"

STOP_SQL = (
    "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it',"
    "'no','not','of','on','or','such','that','the','their','then','there','these','they',"
    "'this','to','was','will','with')"
)


def terms_sql(source: str, key: str, text: str) -> str:
    """SELECT of (key, term, position) for an analysed text column."""
    return f"""
  SELECT {key}, term, position FROM (
    SELECT {key}, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS position
    FROM (SELECT {key}, regexp_extract_all(lower({text}), '{WORD_SQL}') AS words
          FROM {source}))
  WHERE term NOT IN {STOP_SQL}"""


NORM_SQL = (
    "floor(4 / sqrt(n_terms) / pow(2, floor(log2(1 / sqrt(n_terms)) + 1e-12)))"
    " / 4 * pow(2, floor(log2(1 / sqrt(n_terms)) + 1e-12))"
)

POSTINGS_SQL = f"""
occurrences AS ({terms_sql("documents", "doc_id", "text")}),
lengths AS (SELECT doc_id, count(*) AS n_terms FROM occurrences GROUP BY doc_id),
postings AS (
  SELECT term, doc_id, count(*) AS tf, n_terms, {NORM_SQL} AS norm,
         min(position) AS first_position, max(position) AS last_position
  FROM occurrences JOIN lengths USING (doc_id) GROUP BY term, doc_id, n_terms),
corpus AS (SELECT count(*) AS n_docs FROM documents),
dictionary AS (
  SELECT term, count(*) AS df, 1 + ln(any_value(n_docs) / (count(*) + 1)) AS idf
  FROM postings, corpus GROUP BY term)"""
