import random
from datetime import datetime, timedelta, timezone

import corpora
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.operators import history, predicates, scrape, schedule, selectors, stored_views
from pagelake.operators.links import Step
from pagelake.operators.nodes import with_nodes
from pagelake.operators.ordering import number_all, number_within, previous_within
from pagelake.plans.crawl import directed_crawl, recently_stored, unvisited
from pagelake.schemas import CRAWLED_PAGE, PAGE_KIND, SCRAPE_KIND
from pagelake.sources import store
from pagelake.sources.snapshot import snapshot_from_files

START = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
RUN_A, RUN_B = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"


def version(spark, rows):
    """(doc_id, tag, run, uri, minutes after START) rows as crawled pages."""
    full = [
        (doc, tag, datetime.fromisoformat(run), uri, START + timedelta(minutes=at), 1.0, [uri], 200,
         {"foo": "bar"}, f"body of {doc}")
        for doc, tag, run, uri, at in rows
    ]
    return spark.createDataFrame(full, CRAWLED_PAGE)


@pytest.fixture(scope="module")
def versions(spark):
    return version(spark, [
        ("p1", "t", RUN_A, "http://h.example/", 0), ("p2", "t", RUN_A, "http://h.example/", 1),
        ("p3", "t", RUN_A, "http://h.example/x", 2), ("p4", "other", RUN_A, "http://h.example/", 9),
    ])


def ids(frame):
    return [row["doc_id"] for row in frame.collect()]


def test_page_history(versions):
    assert ids(history.page_history(versions, "t", "http://h.example/", 10)) == ["p2", "p1"]
    assert ids(history.page_history(versions, "t", "http://h.example/")) == ["p2", "p1"]
    assert ids(history.latest_page(versions, "t", "http://h.example/")) == ["p2"]
    assert ids(history.latest_page(versions, "t", "http://h.example/none")) == []
    assert sorted(ids(history.latest_pages(versions))) == ["p2", "p3", "p4"]
    assert sorted(ids(history.page_histories(versions, 1))) == ["p2", "p3", "p4"]


def test_run_paging(spark):
    pages = version(spark, [
        (f"{run[9]}{n}", "t", run, f"http://h.example/p{n}", n) for run in (RUN_A, RUN_B) for n in range(1, 11)
    ])
    assert history.run_pages(pages, "t", RUN_A, 100).documents.count() == 10
    first = history.run_pages(pages, "t", RUN_A, 5)
    assert ids(first.documents) == ["19", "18", "17", "16", "15"]
    cursor = first.next.first()
    assert (cursor["uri"], cursor["doc_id"]) == ("http://h.example/p4", "14")
    second = history.run_pages(
        pages, "t", RUN_A, 5, cursor["uri"], cursor["crawled_at"], cursor["doc_id"]
    )
    assert ids(second.documents) == ["14", "13", "12", "110", "11"]
    assert second.next.count() == 0
    whole = history.run_pages(pages, "t", RUN_B)
    assert whole.documents.count() == 10 and whole.next.count() == 0


def test_paging_over_equal_keys(spark):
    """Versions of one page at one instant are told apart by their id."""
    pages = version(spark, [(f"d{n}", "t", RUN_A, "http://h.example/", 0) for n in range(7)])
    seen, cursor = [], {}
    while True:
        page = history.run_pages(pages, "t", RUN_A, 3, **cursor)
        seen += ids(page.documents)
        row = page.next.first()
        if row is None:
            break
        cursor = {f"start_{name}": row[name] for name in ("uri", "crawled_at", "doc_id")}
    assert seen == [f"d{n}" for n in range(6, -1, -1)]


def test_scrape_result_paging(spark, versions):
    results = scrape.scrape(versions, {"title": F.upper("body")})
    first = history.run_scrape_results(results, "t", RUN_A, 2)
    assert [row["uri"] for row in first.documents.collect()] == ["http://h.example/x", "http://h.example/"]
    cursor = first.next.first()
    rest = history.run_scrape_results(results, "t", RUN_A, 2, cursor["uri"], cursor["doc_id"])
    assert rest.documents.count() == 1 and rest.next.count() == 0


def test_views(versions):
    mixed = store.mixed_documents(versions, scrape.scrape(versions, None))
    assert ids(history.view_pages(mixed)) == ["p4", "p1", "p2", "p3"]
    assert history.view_page_keys(mixed).columns == ["uri", "crawl_tag", "crawled_at"]
    assert ids(history.view_pages_by_run(mixed)) == ["p4", "p1", "p2", "p3"]
    assert ids(history.view_by_crawl_date(mixed, START + timedelta(minutes=1), START + timedelta(minutes=2))) == ["p2", "p3"]
    assert history.view_scrape_results(mixed).count() == 4
    assert store.of_kind(mixed, PAGE_KIND).count() == store.of_kind(mixed, SCRAPE_KIND).count() == 4


def test_store_appends_and_replaces_runs(spark, shop, tmp_path):
    path = str(tmp_path / "store")
    pages = store.stamp_pages(shop, "tag", RUN_A, RUN_A, F.lit(1.0))
    assert store.read_documents(spark, path, pages.schema).count() == 0
    store.append_documents(pages, path)
    later = store.stamp_pages(shop, "tag", RUN_B, RUN_B)
    store.append_documents(later, path)
    stored = store.read_documents(spark, path, pages.schema)
    assert stored.count() == 28 and stored.select("doc_id").distinct().count() == 28
    assert stored.filter("score is null").count() == 14
    store.replace_run(later.limit(3), path)
    assert store.read_documents(spark, path, pages.schema).count() == 17
    run = store.read_documents(spark, path, pages.schema).filter(F.col("crawl_timestamp") == F.lit(RUN_B).cast("timestamp"))
    assert "PartitionFilters: [isnotnull(crawl_timestamp" in run._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two runs in two appends each, whose files overlap; some keys occur several times."""
    from unittest import mock
    path = str(tmp_path_factory.mktemp("views") / "store")
    rng = random.Random(8)
    rows = [
        (f"d{n:03}", rng.choice(["t", "t", "u"]), rng.choice([RUN_A, RUN_B]),
         f"http://h.example/{rng.randrange(60):02}", rng.randrange(5)) for n in range(500)
    ]
    with mock.patch.object(store, "ROWS_PER_FILE", 20):
        for part in (rows[:300], rows[300:]):
            pages = version(spark, part)
            mixed = store.mixed_documents(pages, scrape.scrape(pages, {"size": F.length("body")}))
            store.append_documents(mixed, path)
    return store.read_documents(spark, path, mixed.schema), rows


def _paged(view, limit, descending):
    found, start = [], None
    while True:
        page = view.page(limit, start, descending)
        found += [tuple(row[name] for name in view.keys) for row in page.documents.collect()]
        cursor = page.next.first()
        if cursor is None:
            return found
        start = cursor.asDict()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("view", [
    lambda d: stored_views.run_pages(d, "t", RUN_A), stored_views.pages, stored_views.pages_by_run,
    lambda d: stored_views.run_scrape_results(d, "u", RUN_B),
    lambda d: stored_views.by_crawl_date(d, START + timedelta(minutes=1), START + timedelta(minutes=3)),
])
def test_stored_views_page_by_page(stored, view, descending):
    documents, _ = stored
    found = view(documents)
    expected = sorted(
        (tuple(row[name] for name in found.keys) for row in found.rows.collect()), reverse=descending
    )
    assert len(expected) > 60
    assert _paged(found, 37, descending) == expected
    middle = expected[len(expected) // 2]
    from_there = found.page(10, dict(zip(found.keys, middle)), descending).documents
    assert [tuple(row[name] for name in found.keys) for row in from_there.collect()] == (
        expected[len(expected) // 2:][:10]
    )


def test_pages_of_a_view_are_bounded_scans(spark, stored):
    documents, rows = stored
    view = stored_views.run_pages(documents, "t", RUN_A)
    assert view.ranges.count() > 5
    size = view.rows.count()
    assert size == sum(row[1:3] == ("t", RUN_A) for row in rows)
    near = view._near(10, {"uri": "http://h.example/50"}, True)
    assert near.count() < size / 2
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = near._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = text[text.index("FileScan"):]
    assert "PartitionFilters: [isnotnull(crawl_tag" in scan and "Sort" not in text
    assert "LessThanOrEqual(uri,http://h.example/50)" in scan and "GreaterThanOrEqual(uri," in scan
    assert view.page(10, {"uri": "http://h.example/"}, True).documents.count() == 0
    assert stored_views.run_pages(documents, "none", RUN_A).page(10).next.count() == 0
    keys = stored_views.page_keys(documents)
    assert "body" not in keys.rows.columns


def test_bodies_of_versions_are_not_shuffled(spark, stored):
    documents = store.of_kind(stored[0], PAGE_KIND)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (history.latest_pages(documents), history.page_histories(documents, 2)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            exchanges = [line for line in plan.splitlines() if "Exchange" in line]
            assert len(exchanges) == 1 and "BroadcastExchange" in exchanges[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("most", [0, 10**6])
def test_versions_of_many_pages(stored, monkeypatch, most):
    """Latest and newest versions against brute force, with and without a broadcast."""
    monkeypatch.setattr(history, "BROADCAST_ROWS", most)
    documents, rows = stored
    pages = store.of_kind(documents, PAGE_KIND)
    by_page = {}
    for doc, tag, _, uri, at in rows:
        by_page.setdefault((uri, tag), []).append((at, doc))
    newest = {key: [doc for _, doc in sorted(found)[::-1]] for key, found in by_page.items()}
    latest = history.latest_pages(pages).collect()
    assert {(row["uri"], row["crawl_tag"]): row["doc_id"] for row in latest} == {
        key: docs[0] for key, docs in newest.items()
    }
    assert all(row["body"] == f"body of {row['doc_id']}" for row in latest) and len(latest) == len(newest)
    found = {
        (row["uri"], row["crawl_tag"], row["version"]): row["doc_id"]
        for row in history.page_histories(pages, 3).collect()
    }
    assert found == {
        (*key, at): doc for key, docs in newest.items() for at, doc in enumerate(docs[:3], 1)
    }


def test_scrape_identity_wins(versions):
    rows = scrape.scrape_run(versions, "t", RUN_A, {"uri": F.lit("mine"), "size": F.length("body")})
    assert set(rows.columns) == {"doc_id", "type", "uri", "crawled_at", "crawl_tag", "crawl_timestamp", "size"}
    assert {row["uri"] for row in rows.collect()} == {"http://h.example/", "http://h.example/x"}
    assert scrape.scrape_run(versions, "t", RUN_A, None).count() == 3
    assert scrape.scrape_run(versions, "t", RUN_B, None).count() == 0


def test_recrawl_suppression(spark):
    pages = version(spark, [
        ("a", "t", RUN_A, "http://h.example/old", -61), ("b", "t", RUN_A, "http://h.example/edge", -60),
        ("c", "t", RUN_A, "http://h.example/new", -59), ("d", "t", RUN_A, "http://h.example/old", -500),
        ("e", "other", RUN_A, "http://h.example/old", -1),
    ])
    fresh = recently_stored(pages, "t", "2024-01-01T12:00:00Z")
    assert [row["uri"] for row in fresh.collect()] == ["http://h.example/new"]
    assert unvisited(pages.select("uri").distinct(), fresh).count() == 2


def test_positions_match_a_plain_window(spark):
    """A group that holds most rows, and a null group, over several blocks."""
    rows = spark.range(500).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id",
    )
    expected = {}
    for row in sorted(rows.collect(), key=lambda r: (r["k"], r["id"])):
        expected.setdefault(row["g"], []).append((row["id"], row["k"]))
    numbered = number_within(rows, "g", ["k", "id"]).collect()
    assert len(numbered) == 500
    for row in numbered:
        assert expected[row["g"]][row["position"] - 1][0] == row["id"]
    for row in previous_within(rows, "g", ["k", "id"], "k").collect():
        at = expected[row["g"]].index((row["id"], row["k"]))
        assert row["previous"] == (expected[row["g"]][at - 1][1] if at else None)
    ranks = {row["id"]: row["rank"] for row in number_all(rows, [F.desc("k"), F.asc("id")]).collect()}
    order = sorted(rows.collect(), key=lambda r: (-r["k"], r["id"]))
    assert all(ranks[row["id"]] == at for at, row in enumerate(order, 1))


def test_schedule_and_audit(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 3)], "host string, seq int")
    planned = schedule.fetch_schedule(asked, "2024-01-01T00:00:00Z", 100)
    seen = {(row["host"], row["seq"]): row["fetch_at"].microsecond // 1000 for row in planned.collect()}
    assert seen == {("a", 1): 0, ("a", 2): 100, ("a", 3): 200, ("b", 1): 0}
    fetched = planned.select("host", F.col("fetch_at").alias("crawled_at"), F.concat("host", "seq").alias("doc_id"))
    assert schedule.politeness_audit(fetched, 99).filter("not polite").count() == 0
    assert schedule.politeness_audit(fetched, 100).filter("not polite").count() == 2


def test_predicates(spark):
    rows = spark.createDataFrame([(1, "x"), (5, "y"), (None, "z")], "n int, s string")

    def kept(predicate):
        return [row["s"] for row in rows.filter(predicate).collect()]

    n, s = F.col("n"), F.col("s")
    assert kept(predicates.numeric_range(n, 1, 5)) == ["x", "y"]
    for low, high in ((5, 1), (1, None), (None, 1), (1, 2.0)):
        assert predicates.numeric_range(n, low, high) is None
    assert predicates.date_range(n, None, "2024-01-01T00:00:00Z") is None
    assert predicates.combine() is None and predicates.combine(n > 1) is None
    assert kept(predicates.combine(n >= 1, "must", s == "x", "must_not")) == ["y"]
    assert kept(predicates.combine(s == "x", "should", s == "z", "should")) == ["x", "z"]
    assert kept(predicates.combine(s == "x", "must_not")) == []
    with pytest.raises(ValueError):
        predicates.combine(n > 1, "perhaps")
    assert kept(predicates.link_allowed(s, None)) == ["x", "y", "z"]
    assert kept(predicates.link_allowed(s, n > 1)) == ["y"]


def test_scrape_of_a_directed_crawl(spark, shop):
    """Crawl, parse, scrape by selector; then read the results in descending order."""
    steps = [Step("ul#menu a", path_filter="^/goods.+", next=(Step("div#content a"),))]
    pages = directed_crawl(shop, [f"{corpora.SHOP}/index.html"], steps, "t", RUN_A, RUN_A)
    title = selectors.first_or_null(selectors.trimmed_content(F.col("nodes"), "title"))
    results = scrape.scrape_run(with_nodes(pages, "body"), "t", RUN_A, {"page_title": title})
    found, cursor = [], {}
    while True:
        page = history.run_scrape_results(results, "t", RUN_A, 3, **cursor)
        found += [(row["uri"], row["page_title"]) for row in page.documents.collect()]
        row = page.next.first()
        if row is None:
            break
        cursor = {"start_uri": row["uri"], "start_doc_id": row["doc_id"]}
    assert found == sorted(
        ((uri, html.split("<title>")[1].split("</title>")[0]) for uri, html in corpora.shop_pages()),
        reverse=True,
    )


def test_scrape_with_a_function(versions):
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("uri", T.StringType())])

    def sizes(batch):
        return batch.assign(size=batch["body"].str.len(), uri="mine")

    rows = scrape.scrape_with(versions, sizes, schema).collect()
    expected = scrape.scrape(versions, {"size": F.length("body").cast("bigint")})
    assert {tuple(sorted(row.asDict().items())) for row in rows} == {
        tuple(sorted(row.asDict().items())) for row in expected.collect()
    }
    nothing = scrape.scrape_with(versions, lambda batch: None, schema)
    assert nothing.filter("size is null").count() == 4
    with pytest.raises(Exception, match="results for"):
        scrape.scrape_with(versions, lambda batch: batch.head(0), schema).collect()


def test_snapshot_from_files(spark, tmp_path):
    for uri, html in corpora.deep_pages():
        (tmp_path / uri.rsplit("/", 1)[1]).write_text(html)
    pages = snapshot_from_files(spark, str(tmp_path), corpora.DEEP)
    assert {(row["uri"], row["body"]) for row in pages.collect()} == set(corpora.deep_pages())
