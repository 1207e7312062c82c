import re
from html import unescape

import corpora
import pytest
from pyspark.sql import functions as F

from pagelake.functions import html as html_text
from pagelake.operators import links, selectors
from pagelake.operators.links import Step, numbered_steps
from pagelake.operators.nodes import node_rows, with_nodes

MENU = {"/", "/fr", "/goods/teas.html", "/goods/pots.html", "/about.html", "/contact.html"}


def shop_links(*paths):
    return {corpora.SHOP + path for path in paths}


def body(name):
    return dict(corpora.shop_pages())[f"{corpora.SHOP}/{name}"]


def parsed(spark, *pages):
    rows = [(f"{corpora.SHOP}/{at}", html) for at, html in enumerate(pages)]
    return with_nodes(spark.createDataFrame(rows, "url string, html string"))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_page_links(spark, shop):
    page = shop.filter(F.col("uri").endswith("teas.html"))
    found = {row["dst_uri"] for row in links.page_links(page, "uri", "body").collect()}
    assert found == shop_links(*MENU, *[f"/{tea}.html" for tea in corpora.TEAS])


def test_links_of_odd_anchors(spark):
    html = """<A HREF=plain>a</A><a title="x href='no'" href='single?a=1&amp;b=2'>b</a>
      <a name="anchor">c</a><a
      class=x href = "spaced">d</a><abbr href="e"></abbr><a href="plain#again">f</a>
      <a href="mailto:x">g</a><a href="/a b">h</a><!-- <a href="hidden"> -->
      <a href="?x=1&copy=2">i</a>"""
    page = spark.createDataFrame([("http://h.example/p", html)], "url string, html string")
    found = [row["dst_uri"] for row in links.page_links(page).collect()]
    assert found == [
        "http://h.example/plain", "http://h.example/single?a=1&b=2",
        "http://h.example/spaced", "http://h.example/p?x=1&copy=2",
    ]
    rejected = {row["href"] for row in links.rejected_links(page).collect()}
    assert rejected == {"mailto:x", "/a b"}


def test_selector_links_and_filters(spark):
    pages = parsed(spark, body("index.html"))

    def found(selector, **filters):
        return {row["dst_uri"] for row in links.selector_links(pages, selector, **filters).collect()}

    everything = found("a")
    assert everything == shop_links(*MENU) | {corpora.ELSEWHERE}
    assert found("a", path_filter="^/goods.+") == shop_links("/goods/teas.html", "/goods/pots.html")
    assert found("a", filter="http://elsewhere.*") == {corpora.ELSEWHERE}
    assert found("a", filter="http://elsewhere.*", path_filter="/") == {corpora.ELSEWHERE}
    assert found("a", path_filter="/") == {corpora.ELSEWHERE, corpora.SHOP + "/"}
    assert found("div#content a") == {corpora.ELSEWHERE}


def test_steps(spark):
    pages = parsed(spark, body("index.html"))
    steps = numbered_steps([
        Step("ul#menu a", path_filter="^/goods.+", next=(Step("div#content a"),)),
        Step("a", path_filter="^/goods/t.+"),
    ])
    assert [(s.step_id, s.parent_step_id, s.ord) for s in steps] == [(1, 0, 0), (2, 0, 1), (3, 1, 0)]
    found = links.step_links(pages, steps[:2]).collect()
    assert sorted((row["step_id"], row["dst_uri"].rsplit("/", 1)[1]) for row in found) == [
        (1, "pots.html"), (1, "teas.html"), (2, "teas.html"),
    ]


def test_plaintext(spark):
    assert one(spark, html_text.plaintext(F.lit(body("index.html")))) == (
        "Tea House Tea House Find Français Start Teas Pots About Contact Tea House "
        "We sell tea and pots! Friends © 2024, Tea House & Co."
    )
    assert one(spark, html_text.plaintext(F.lit("<p>a<b>b</b>c<br>d</p>e"))) == "abc d e"


def test_entities_follow_the_standard_library(spark):
    texts = ["a &amp;lt; b", "&#8364;&#x20AC;&euro;", "AT&T &unknown; &", "&copy 2024", "&eacute;t&eacute;"]
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    for row in frame.select("t", html_text.decode_entities(F.col("t")).alias("v")).collect():
        assert row["v"] == unescape(row["t"])


def test_trimmed_content(spark):
    pages = parsed(spark, body("assam.html"))

    def content(selector):
        return pages.select(selectors.trimmed_content(F.col("nodes"), selector).alias("v")).first()["v"]

    assert content("#description") == ["A fine assam."]
    assert content("#content div span:nth-of-type(2)") == ["assam origin", "assam maker", "assam grade"]
    assert content(".value") == content("span.value")
    assert content("li.entry.first a") == ["Start"]
    assert content("table") == []
    first = pages.select(selectors.first_or_null(selectors.trimmed_content(F.col("nodes"), "table")).alias("v"))
    assert first.first()["v"] is None


@pytest.mark.parametrize("selector", ["a > b", "a[href]", "", "p:first-child"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        selectors.chain(selector)


def test_descendants_match_brute_force(spark):
    """Interval containment against walking up the tree by depth."""
    pages = parsed(spark, *[html for _, html in corpora.shop_pages()])
    for row in pages.collect():
        stack, expected = [], []
        for node in row["nodes"]:
            del stack[node["depth"]:]
            stack.append(node)
            tags = [above["tag"] for above in stack]
            if tags[-1] == "a" and any(
                tags[at] == "ul" and "li" in tags[at + 1:-1] for at in range(len(tags) - 1)
            ):
                expected.append(node["pre"])
        found = pages.filter(F.col("url") == row["url"]).select(
            F.transform(selectors.select_nodes(F.col("nodes"), "ul li a"), lambda n: n["pre"]).alias("v")
        ).first()["v"]
        assert found == expected


def test_tolerant_tree(spark):
    html = "<p>one<p>two<b>bold<ul><li>x<li>y<br></ul>tail<table><tr><td>1<td>2<tr><td>3</table>"
    nodes = parsed(spark, html)
    by_tag = {}
    for node in node_rows(nodes, "url").collect():
        by_tag.setdefault(node["tag"], []).append(node)
    assert [n["own_text"] for n in by_tag["p"]] == ["one", "two"]
    assert [n["own_text"] for n in by_tag["li"]] == ["x", "y"]
    assert [n["nth_of_type"] for n in by_tag["td"]] == [1, 2, 1]
    assert {n["depth"] for n in by_tag["td"]} == {by_tag["table"][0]["depth"] + 2}
    for n in by_tag["td"]:
        table = by_tag["table"][0]
        assert table["pre"] < n["pre"] and n["post"] < table["post"]


def test_link_degrees(spark, deep):
    graph = {row["uri"]: row for row in links.link_degrees(links.page_links(deep, "uri", "body")).collect()}
    assert graph[f"{corpora.DEEP}/index.html"]["in_degree"] == 0
    assert graph[f"{corpora.DEEP}/nested-3a.html"]["in_degree"] == 2
    assert graph[f"{corpora.DEEP}/nested-10a.html"]["out_degree"] == 0
    assert sum(row["in_degree"] for row in graph.values()) == 42


def test_missing_html(spark):
    pages = spark.createDataFrame([("http://h.example/", None)], "url string, html string")
    assert with_nodes(pages).first()["nodes"] == []
    assert links.page_links(pages).count() == 0


def test_long_references_and_titles(spark):
    from pagelake.functions import html
    page = "<!-- <title>no</title> --><script>'<title>no</title>'</script><title>\n  A &#00000065;&#x0000000042; \n B\t</title>"
    frame = spark.createDataFrame([(page, "&#99999999999; &#x110000; &#0065")], "h string, t string")
    row = frame.select(html.title(F.col("h")).alias("title"), html.decode_entities(F.col("t")).alias("t")).first()
    assert row["title"] == "A AB \n B"
    assert row["t"] == "&#99999999999; &#x110000; A"


def test_tokens_of_any_length(spark):
    from pagelake.functions import analysis
    frame = spark.createDataFrame([("x" * 300 + " tea",)], "t string")
    assert frame.select(analysis.terms(F.col("t"))).first()[0] == ["x" * 300, "tea"]
    assert frame.select(analysis.terms(F.col("t"), 255)).first()[0] == ["tea"]


def test_selection_grows_with_the_elements(spark):
    """Twenty times the elements must not take four hundred times as long."""
    import time

    def seconds(pairs):
        page = spark.createDataFrame([("<div><p>x</p></div>" * pairs,)], "body string")
        parsed = with_nodes(page, "body")
        start = time.perf_counter()
        found = parsed.select(F.size(selectors.select_nodes(F.col("nodes"), "div p"))).first()[0]
        assert found == pairs
        return time.perf_counter() - start

    seconds(10)
    assert seconds(20_000) < 60 * max(seconds(1_000), 0.5)


def test_nested_ancestors(spark):
    body = "<div id=a><p>1</p><div id=b><p>2</p></div><p>3</p></div><p>4</p><div id=c></div>"
    parsed = with_nodes(spark.createDataFrame([(body,)], "body string"), "body")
    found = parsed.select(selectors.trimmed_content(F.col("nodes"), "div p").alias("v")).first()["v"]
    assert found == ["1", "2", "3"]


def test_deep_nesting_is_followed_once(spark):
    """The same matches as by definition, also where runs lie in each other many times."""
    depth = 60
    deep = "<div>" * depth + '<p class="x">in</p>' + "</div>" * depth
    page = f'<div><p class="x">a</p><p>b</p></div>{deep}<div><div><p class="x">c</p></div></div><p class="x">d</p>'
    pages = with_nodes(spark.createDataFrame([("u", page)], "uri string, body string"), "body")
    found = pages.select(
        selectors.trimmed_content(F.col("nodes"), "div p.x").alias("one"),
        selectors.trimmed_content(F.col("nodes"), "div div p").alias("two"),
    ).first()
    assert found["one"] == ["a", "in", "c"] and found["two"] == ["in", "c"]
