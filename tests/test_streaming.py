import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagelake.functions import html as html_text
from pagelake.operators import scrape
from pagelake.sources import store
from pagelake.streaming import incremental

RUN = "2024-01-01T00:00:00Z"


def test_incremental_scrape_equals_batch(spark, shop, tmp_path):
    arriving, results, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    pages = store.stamp_pages(shop, "t", RUN, RUN)
    columns = {"title": html_text.title(F.col("body"))}
    expected = scrape.scrape(pages, columns)
    halves = [pages.filter(F.col("uri").contains("goods")), pages.filter(~F.col("uri").contains("goods"))]
    for half in halves:
        store.append_documents(half, arriving)
        stream = incremental.stream_table(spark, arriving, pages.schema, files_per_trigger=1)
        incremental.scrape_stream(stream, columns, results, checkpoint).awaitTermination()
    stored = store.read_documents(spark, results, expected.schema)
    key = ["doc_id", "uri", "title"]
    assert sorted(map(tuple, stored.select(key).collect())) == sorted(map(tuple, expected.select(key).collect()))


def test_recrawls_are_dropped_until_the_window_has_passed(spark, tmp_path):
    arriving, passed, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    start = datetime(2024, 1, 1)
    schema = "doc_id string, crawl_tag string, uri string, crawled_at timestamp"
    # One file per batch, in order of arrival; 60 minutes after an accepted one is new.
    batches = [
        [("a1", "t", "/a", 0), ("a2", "t", "/a", 1), ("b1", "t", "/b", 2), ("x1", "other", "/a", 2),
         ("b2", "t", "/b", 59), ("b3", "t", "/b", 62), ("b4", "t", "/b", 121), ("b5", "t", "/b", 122)],
        [("a3", "t", "/a", 30), ("n1", None, "/a", 30), ("n2", None, "/a", 31)],
        [("c1", "t", "/c", 300), ("a5", "t", "/a", 60)], [("c2", "t", "/c", 310)],
        [("a4", "t", "/a", 320), ("a6", "t", "/a", 119), ("b6", "t", "/b", 181)],
    ]
    for rows in batches:
        frame = spark.createDataFrame(
            [(doc, tag, uri, start + timedelta(minutes=at)) for doc, tag, uri, at in rows], schema
        )
        frame.coalesce(1).write.mode("append").parquet(arriving)
        stream = incremental.stream_table(spark, arriving, frame.schema)
        incremental.suppress_recrawls(stream, passed, checkpoint).awaitTermination()
    kept = {row["doc_id"] for row in spark.read.parquet(passed).collect()}
    assert kept == {"a1", "b1", "x1", "b3", "b5", "n1", "c1", "a5", "a4"}


def _greedy(rows, minutes, last=None):
    """Ids that pass, of (id, tag, uri, minutes) rows, going through them one by one."""
    last, passed = dict(last or {}), set()
    for doc, tag, uri, at in sorted(rows, key=lambda row: (row[3], row[0])):
        before = last.get((tag, uri))
        if before is None or at - before >= minutes:
            last[tag, uri] = at
            passed.add(doc)
    return passed


@pytest.mark.parametrize("hot", [1, 40, 10**6])
def test_ranges_of_requests_are_chained(spark, monkeypatch, hot):
    """One page holds most requests; whatever is cut into ranges, the same ones pass."""
    monkeypatch.setattr(incremental, "HOT_ROWS", hot)
    rng = random.Random(hot)
    start = datetime(2024, 1, 1)
    rows = [
        (f"d{n:04}", rng.choice(["t", "t", None]), rng.choice(["/hot"] * 5 + ["/a", "/b", None]),
         rng.choice([rng.randrange(3000), rng.randrange(100) * 30]))
        for n in range(600)
    ]
    schema = "doc_id string, crawl_tag string, uri string, crawled_at timestamp"

    def frame(rows):
        return spark.createDataFrame(
            [(doc, tag, uri, start + timedelta(minutes=at)) for doc, tag, uri, at in rows], schema
        ).repartition(7)
    accepted = [("x", "t", "/hot", 40), ("y", None, "/a", 500)]
    requests = frame(rows).union(spark.createDataFrame([("none", "t", "/hot", None)], schema))
    for minutes in (60, 7):
        found = incremental.accepted_requests(requests, frame(accepted), minutes).collect()
        expected = _greedy(rows, minutes, {(tag, uri): at for _, tag, uri, at in accepted})
        assert len(found) == len(expected) and {row["doc_id"] for row in found} == expected


def test_state_expires_by_event_time(spark, tmp_path):
    """Batches in order of time: the same requests pass, and old pages leave the state."""
    arriving, passed, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(f"d{n:03}", "t", f"/{rng.randrange(4)}" if n < 150 else "/late", n * 4) for n in range(200)]
    schema = "doc_id string, crawl_tag string, uri string, crawled_at timestamp"
    kept = []
    for first in range(0, 200, 50):
        part = rows[first:first + 50]
        rng.shuffle(part)
        frame = spark.createDataFrame(
            [(doc, tag, uri, start + timedelta(minutes=at)) for doc, tag, uri, at in part], schema
        )
        frame.coalesce(1).write.mode("append").parquet(arriving)
        stream = incremental.stream_table(spark, arriving, frame.schema)
        query = incremental.suppress_recrawls(stream, passed, checkpoint, lateness="10 minutes")
        query.awaitTermination()
        kept.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert {row["doc_id"] for row in spark.read.parquet(passed).collect()} == _greedy(rows, 60)
    # The state of one page, and its timer; the other four have expired.
    assert kept[0] > kept[-1]


def test_pages_share_calls_to_the_state(spark, tmp_path):
    """Many pages with few requests each: rows of state, each read once a batch, are fewer."""
    arriving, passed, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id").cast("bigint"))
    frame = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "t").alias("crawl_tag"),
        F.when(F.col("id") % 3000 > 0, F.concat(F.lit("/"), F.col("id") % 3000)).alias("uri"),
        at.alias("crawled_at"),
    )
    frame.coalesce(1).write.parquet(arriving)
    stream = incremental.stream_table(spark, arriving, frame.schema)
    query = incremental.suppress_recrawls(stream, passed, checkpoint, minutes=90)
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= incremental.STATE_GROUPS
    rows = [(row[0], row[1], row[2], row[0]) for row in frame.collect()]
    kept = [row["doc_id"] for row in spark.read.parquet(passed).collect()]
    assert sorted(kept) == sorted(_greedy(rows, 90 * 60)) and 3000 <= len(kept) < 9000
