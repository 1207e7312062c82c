import corpora
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelake.functions import html as html_text
from pagelake.operators.links import Step
from pagelake.plans.crawl import directed_crawl, weighted_crawl
from pagelake.sources.snapshot import fetch

RUN = "2024-01-01T12:00:00Z"
MENU = Step("ul#menu a", path_filter="^/goods.+")
CONTENT = Step("div#content a")
SEED = f"{corpora.DEEP}/index.html"


def crawl(snapshot, seeds=(SEED,), max_depth=1000, score=None, **options):
    return weighted_crawl(
        snapshot, list(seeds), max_depth, F.lit(0.1) if score is None else score(),
        "test", RUN, RUN, **options,
    )


def names(frame):
    return sorted(row["uri"].rsplit("/", 1)[1] for row in frame.collect())


def all_names(levels=10):
    return sorted(["index.html"] + [f"nested-{n}{s}.html" for n in range(levels) for s in "ab"])


def test_fetch(spark, shop):
    asked = spark.createDataFrame([(f"{corpora.SHOP}/index.html",), ("foo",)], "uri string")
    found = {row["uri"]: row for row in fetch(asked, shop).collect()}
    assert found[f"{corpora.SHOP}/index.html"]["status"] == 200
    assert found[f"{corpora.SHOP}/index.html"]["trace_redirects"] == [f"{corpora.SHOP}/index.html"]
    assert found["foo"]["body"] is None


@pytest.mark.parametrize("steps", [
    [Step("ul#menu a", path_filter="^/goods.+", next=(CONTENT,))],
    [Step("ul#menu a", path_filter="^/goods.+", next=(
        Step("div#content a", next=(MENU,)), MENU,
    ))],
])
def test_directed_crawl(spark, shop, steps):
    pages = directed_crawl(shop, [f"{corpora.SHOP}/index.html"], steps, "test", RUN, RUN)
    assert sorted(row["uri"] for row in pages.collect()) == sorted(uri for uri, _ in corpora.shop_pages())
    row = pages.first()
    assert row["score"] is None and row["crawl_tag"] == "test" and row["status"] == 200


def test_directed_crawl_keeps_failed_fetches(spark, shop):
    steps = [Step("ul#menu a", next=(CONTENT,))]
    pages = directed_crawl(shop, [f"{corpora.SHOP}/index.html"], steps, "test", RUN, RUN)
    failed = {row["uri"] for row in pages.filter("status is null").collect()}
    assert failed == {corpora.SHOP + path for path in ("/", "/about.html", "/contact.html")}


def test_first_step_wins(spark):
    pages = corpora.snapshot(spark, [
        ("http://s.example/", '<p><a href="/x">x</a></p>'), ("http://s.example/x", '<i><a href="/y">'),
        ("http://s.example/y", ""),
    ])
    blunt = [Step("p a"), Step("a", next=(Step("i a"),))]
    found = directed_crawl(pages, ["http://s.example/"], blunt, "t", RUN, RUN)
    assert sorted(row["uri"] for row in found.collect()) == ["http://s.example/", "http://s.example/x"]
    keen = directed_crawl(pages, ["http://s.example/"], blunt[::-1], "t", RUN, RUN)
    assert keen.count() == 3


def test_full_crawl(spark, deep):
    result = crawl(deep, link_filter=lambda uri: uri.rlike(r"\Ahttp://deep\..*"))
    assert names(result.stored) == all_names()
    row = result.stored.first()
    assert row["score"] == pytest.approx(0.1)
    assert row["crawled_at"] == row["crawl_timestamp"]
    # Two links of the last level lead nowhere: attempted, not stored.
    assert result.attempted.count() == 23


def test_zero_score_follows_without_storing(spark, deep):
    result = crawl(
        deep, score=lambda: F.when(F.col("title") == "Nested 0", 0).otherwise(0.1),
        features={"title": html_text.title(F.col("body"))},
    )
    assert names(result.stored) == [n for n in all_names() if "-0" not in n]


def test_negative_score_ends_a_branch(spark, deep):
    known = ["Nested"] + [f"Nested {n}" for n in range(4)]
    result = crawl(
        deep, score=lambda: F.when(F.col("title").isin(known), 0.1).otherwise(-0.1),
        features={"title": html_text.title(F.col("body"))},
    )
    assert names(result.stored) == all_names(4)


def test_link_filter(spark, deep):
    allowed = [SEED] + [f"{corpora.DEEP}/nested-{n}{s}.html" for n in range(4) for s in "ab"]
    assert names(crawl(deep, link_filter=lambda uri: uri.isin(allowed)).stored) == all_names(4)
    assert crawl(deep, link_filter=lambda uri: uri != SEED).stored.count() == 0
    nothing = crawl(deep, link_filter=lambda uri: F.lit(None).cast("boolean"))
    assert nothing.attempted.count() == 0


def test_no_recrawl_within_the_hour(spark, deep):
    first = crawl(deep).stored
    again = crawl(deep, history=first)
    assert again.stored.count() == 0
    old = first.withColumn("crawled_at", F.col("crawled_at") - F.expr("INTERVAL 61 MINUTES"))
    assert crawl(deep, history=old).stored.count() == 21
    assert crawl(deep, history=first.withColumn("crawl_tag", F.lit("other"))).stored.count() == 21


def test_max_depth(spark, deep):
    assert names(crawl(deep, max_depth=3).stored) == all_names(3)
    assert names(crawl(deep, max_depth=0).stored) == ["index.html"]


def test_depth_in_score(spark, deep):
    assert names(crawl(deep, score=lambda: F.lit(2) - F.col("depth")).stored) == all_names(1)


def test_other_hosts(spark, shop):
    result = crawl(shop, [f"{corpora.SHOP}/index.html"]).stored
    assert {row["uri"] for row in result.collect()} == {
        uri for uri, _ in corpora.shop_pages() + corpora.elsewhere_pages()
    }


def test_hop_resets_depth_after_the_gate(spark):
    pages = corpora.snapshot(spark, [
        ("http://a.example/0", '<a href="/1">'),
        ("http://a.example/1", '<a href="http://b.example/0"><a href="/2">'),
        ("http://a.example/2", '<a href="http://c.example/0">'),
        ("http://b.example/0", '<a href="/1">'), ("http://b.example/1", ""),
        ("http://c.example/0", ""),
    ])
    result = crawl(pages, ["http://a.example/0"], max_depth=2)
    depths = {row["uri"]: row["depth"] for row in result.attempted.collect()}
    assert depths == {
        "http://a.example/0": 0, "http://a.example/1": 1, "http://a.example/2": 2,
        "http://b.example/0": 0, "http://b.example/1": 1,
    }


def _joined_in_place(spark, plan):
    """A plan without broadcasts, as lines; how many exchanges it has; settings restored."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    return text


@pytest.mark.parametrize("buckets, exchanges", [(4, 1), (8, 2)])
def test_levels_shuffle_their_candidates_only(spark, deep, buckets, exchanges):
    """Neither links nor the frontier nor the visited set are exchanged."""
    from pagelake.plans import crawl as plan
    from pagelake.sources.uri_tables import Levels
    links = plan._link_table(deep, {}, buckets)
    levels = Levels(spark, "plan", links.buckets)
    levels.add(deep.select("uri", F.lit(0).alias("depth")))

    def level():
        found = plan.outgoing(links, levels.newest(), F.col("depth") < 5)
        once = found.groupBy("uri").agg(F.min("depth").alias("depth"))
        return levels.unvisited(once)
    text = _joined_in_place(spark, level)
    assert text.count("SortMergeJoin") == 2 and text.count("Exchange") == exchanges
    lines = text.splitlines()
    below = [lines[at + 1] for at, line in enumerate(lines) if "Exchange" in line]
    assert all("HashAggregate" in line for line in below)


def test_tasks_of_a_level_follow_the_pages(spark, deep):
    """Many shuffle partitions neither cut the tables finer nor move the visited set."""
    from pagelake.plans import crawl as plan
    from pagelake.sources.uri_tables import Levels
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        buckets = plan._buckets(deep)
        assert buckets == spark.sparkContext.defaultParallelism
        levels = Levels(spark, "plan", buckets)
        levels.add(deep.select("uri", F.lit(0).alias("depth")))

        def level():
            once = deep.groupBy("uri").agg(F.lit(0).alias("depth"))
            return levels.unvisited(once)
        lines = _joined_in_place(spark, level).splitlines()
        dealt = [line for line in lines if "Exchange hashpartitioning(uri" in line]
        assert len(dealt) == 2 and f", {buckets})" in dealt[0] and ", 64)" in dealt[1]
        assert lines.index(dealt[1]) < next(at for at, line in enumerate(lines) if "pagelake_plan" in line)
        assert levels.unvisited(deep.select("uri").distinct()).isEmpty()
        assert names(crawl(deep).stored) == all_names()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_levels_read_the_files_of_their_pages(spark, deep, monkeypatch):
    from pagelake.plans import crawl as plan
    pages = plan.page_table(deep)
    monkeypatch.setattr(plan, "PAGES_PER_BUCKET", 1)
    many = plan.page_table(deep)
    assert many.buckets == 21 and pages.buckets == 4

    def files(table, uris):
        frame = table.holding(spark.createDataFrame([(uri,) for uri in uris], "uri string"))
        return len(frame.inputFiles())
    uris = sorted(row["uri"] for row in deep.select("uri").collect())
    read = [files(many, uris[:n]) for n in (0, 1, 3, 8, 21)]
    assert read[0] == 0 and read[1] == 1 and read == sorted(read) and read[2] <= 3
    assert read[4] == files(many, uris + ["http://else.example/"]) > 8
    kept = many.holding(spark.createDataFrame([(uris[5],)], "uri string"))
    assert uris[5] in {row["uri"] for row in kept.collect()}
    steps = [Step("a", next=(Step("a"),))]
    again = [
        sorted(row["uri"] for row in directed_crawl(table, [SEED], steps, "t", RUN, RUN).collect())
        for table in (pages, many, deep)
    ]
    assert again[0] == again[1] == again[2] and len(again[0]) > 3


def test_many_buckets(spark, deep, monkeypatch):
    from pagelake.plans import crawl as plan
    monkeypatch.setattr(plan, "PAGES_PER_BUCKET", 2)
    assert names(crawl(deep).stored) == all_names()


def test_score_from_a_pandas_function(spark, deep):
    @F.pandas_udf("long")
    def links(bodies: pd.Series) -> pd.Series:
        return bodies.str.count("<a ")

    result = crawl(deep, score=lambda: F.col("links") - 2, features={"links": links("body")})
    assert result.stored.count() == 0
    assert {row["relevance"] for row in result.scored.collect()} == {"follow"}
    assert result.scored.count() == 21
    with pytest.raises(ValueError, match="may not be named"):
        crawl(deep, features={"body": F.lit(1)})


def test_error_responses_count_as_failed(spark, deep):
    gone = {sorted(row["uri"] for row in crawl(deep).stored.collect())[-1]}
    missing = deep.withColumn(
        "status", F.when(F.col("uri").isin(gone), 404).otherwise(F.col("status"))
    )
    result = crawl(missing)
    assert not gone & {row["uri"] for row in result.stored.collect()}
    assert not gone & {row["uri"] for row in result.scored.collect()}


def test_one_response_per_uri(spark):
    from pagelake.sources.snapshot import one_per_uri
    rows = [("/a", 200, "x"), ("/a", 200, "y"), ("/b", 200, "z"), ("/a", 200, "x"), ("/c", None, None), ("/c", None, None)]
    frame = spark.createDataFrame(rows, "uri string, status int, body string")
    found = one_per_uri(frame).collect()
    assert sorted(row["uri"] for row in found) == ["/a", "/b", "/c"]
    assert one_per_uri(frame.orderBy(F.desc("body"))).filter("uri = '/a'").first() in found
