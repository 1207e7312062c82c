from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagelake.functions import times, urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("base, link, expected", [
    ("http://h.example/", "/goods/tea.html", "http://h.example/goods/tea.html"),
    ("http://h.example/goods/tea.html", "../pot.html", "http://h.example/pot.html"),
    ("http://h.example/", "/pot.html#part", "http://h.example/pot.html"),
    ("http://h.example:8080/", "/pot.html", "http://h.example:8080/pot.html"),
    ("http://h.example", "pot.html", "http://h.example/pot.html"),
    ("http://h.example/a/b?x=1", "c?y=2", "http://h.example/a/c?y=2"),
    ("http://h.example/a/b?x=1", "?y=2", "http://h.example/a/b?y=2"),
    ("http://h.example/a/b?x=1", "#top", "http://h.example/a/b?x=1"),
    ("http://h.example/a/b/c", "../../../../d/./e/..", "http://h.example/d/"),
    ("https://h.example/a", "//other.example/x/../y", "https://other.example/y"),
    ("http://h.example/a", "HTTPS://Other.example/x", "HTTPS://Other.example/x"),
    ("http://h.example/a", " /b ", "http://h.example/b"),
    ("http://h.example/a", "mailto:me@h.example", None),
    ("http://h.example/a", "javascript:void(0)", None),
    ("http://h.example/a", "/two words", None),
    ("nonsense", "/a", None),
])
def test_resolve_link(spark, base, link, expected):
    assert one(spark, urls.resolve_link(F.lit(base), F.lit(link))) == expected


def test_resolution_matches_the_standard_library(spark):
    from urllib.parse import urljoin
    bases = ["http://h.example/a/b/c?q=1", "http://h.example/a/"]
    links = ["x", "./x", "../x", "x/../y/./z", "/x/../y", "..", ".", "x?p=../q", "../../x/"]
    rows = [(base, link) for base in bases for link in links]
    frame = spark.createDataFrame(rows, "base string, link string")
    for row in frame.withColumn("v", urls.resolve_link(F.col("base"), F.col("link"))).collect():
        assert row["v"] == urljoin(row["base"], row["link"])


def test_segments_and_hosts(spark):
    parts = one(spark, urls.uri_segments(F.lit("http://h.example:81/a.html?b=/c")))
    assert tuple(parts) == ("http://", "h.example:81", "/a.html?b=/c")
    assert tuple(one(spark, urls.uri_segments(F.lit("http://h.example")))) == (None, None, None)
    same = lambda *uris: one(spark, urls.same_host(*map(F.lit, uris)))
    assert same("http://h.example/a", "http://h.example/b", "https://h.example/")
    assert not same("http://h.example/a", "http://h.example:80/a")
    assert not same("http://h.example/a", "http://H.example/a")
    assert same("http://a.example", "http://b.example")


def test_full_match_is_not_partial(spark):
    assert one(spark, urls.full_match(F.lit("/goods/tea"), "/goods.+"))
    assert not one(spark, urls.full_match(F.lit("/goods/tea"), "/goods|x"))
    assert one(spark, urls.full_match(F.lit(None).cast("string"), ".*")) is False


@pytest.mark.parametrize("headers, expected", [
    ({"content-type": "text/html;charset=UTF-8"}, True),
    ({"content-type": "text/plain;charset=UTF-8"}, False),
    ({"content-type": "Text/html"}, False),
    ({}, False),
])
def test_is_html(spark, headers, expected):
    frame = spark.createDataFrame([(headers,)], "h map<string,string>")
    assert frame.select(urls.is_html(F.col("h")).alias("v")).first()["v"] is expected


@pytest.mark.parametrize("text, expected", [
    ("2011-11-04T09:16:52.253Z", 1320398212253),
    ("2012-01-12T15:40:07+01:00", 1326379207000),
    ("10", None), ("", None), (None, None), ("2011-13-45T09:16:52Z", None),
])
def test_rfc3339_to_millis(spark, text, expected):
    assert one(spark, times.to_millis(F.lit(text).cast("string"))) == expected


def test_zones_and_text_form(spark):
    local = one(spark, times.in_zone(F.lit("2011-11-04T09:16:52.253Z"), "Europe/Amsterdam"))
    assert local == datetime(2011, 11, 4, 10, 16, 52, 253000)
    stamp = F.lit("2012-05-13T21:52:58.114Z")
    assert one(spark, times.to_text(times.parse(stamp))) == "2012-05-13T21:52:58.114Z"


@pytest.mark.parametrize("crawled_at, expected", [
    (None, False), ("2024-01-01T10:59:00Z", False), ("2024-01-01T11:00:00Z", False),
    ("2024-01-01T11:01:00Z", True),
])
def test_recently_crawled(spark, crawled_at, expected):
    now = F.lit("2024-01-01T12:00:00Z").cast("timestamp")
    seen = F.lit(crawled_at).cast("timestamp")
    assert one(spark, times.recently_crawled(seen, now)) is expected
