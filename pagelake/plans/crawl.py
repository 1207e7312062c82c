"""Breadth-first crawls over a page snapshot, one Spark job per level.

Every level is written to a table of the shared folder that is bucketed by URI. All levels
together are the visited set, the newest one is the frontier, and a level is recomputed from
files alone if executors are lost. Pages and links are bucketed alike, so a level shuffles
its candidates and nothing else, and reads the files that can hold its pages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import html as html_text
from pagelake.functions import times, urls
from pagelake.operators.links import ROOT_STEP, Step, numbered_steps, step_links
from pagelake.operators.nodes import with_nodes
from pagelake.session import written
from pagelake.sources.snapshot import fetch, fetch_existing, one_per_uri, successful
from pagelake.sources.store import stamp_pages
from pagelake.sources.uri_tables import Levels, UriTable, write_uri_table

PAGES_PER_BUCKET = 25_000


def recently_stored(
    history: DataFrame, crawl_tag: str, now: Column | str,
    minutes: int = times.RECRAWL_WINDOW_MINUTES,
) -> DataFrame:
    """URIs whose latest stored version under the tag is too fresh to crawl again.

    The latest version is fresh exactly when any version is, so no grouping is needed
    and the time bound reaches the scan.
    """
    fresh = times.recently_crawled(F.col("crawled_at"), times.instant(now), minutes)
    return history.filter((F.col("crawl_tag") == crawl_tag) & fresh).select("uri")


def unvisited(
    candidates: DataFrame, visited: DataFrame, on: str | list[str] = "uri"
) -> DataFrame:
    return candidates.join(visited, on, "left_anti")


def relevance(score: Column) -> Column:
    """What a score means: store and follow, only follow, or neither."""
    return F.when(score > 0, "store").when(score == 0, "follow").otherwise("ignore")


def hop_depth(src_uri: Column, dst_uri: Column, depth: Column) -> Column:
    """Depth of a link's target: one more on the same host, 0 on another one."""
    return F.when(urls.same_host(src_uri, dst_uri), depth + 1).otherwise(F.lit(0))


@dataclass(frozen=True)
class WeightedCrawl:
    """``stored``: stamped pages with a positive score. ``attempted``: (uri, depth,
    level) of every fetch attempt, failed ones included."""

    stored: DataFrame
    attempted: DataFrame
    scored: DataFrame


def _buckets(snapshot: DataFrame) -> int:
    """Buckets of a crawl's tables: few enough pages in each, and work for all cores.

    A level has a task for each of them, however few its pages are, and every task reports
    to the driver; so they do not follow the setting for shuffles.
    """
    cores = snapshot.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-snapshot.count() // PAGES_PER_BUCKET))


def _link_table(snapshot: DataFrame, features: Mapping[str, Column], buckets: int) -> UriTable:
    """Per page: the features the score needs, and its links. One pass over the bodies.

    Levels only read this compact table.
    """
    found = snapshot.select(
        "uri",
        *[column.alias(name) for name, column in features.items()],
        urls.base_parts(F.col("uri")).alias("_base"),
        html_text.anchor_hrefs(F.col("body")).alias("_hrefs"),
    )
    table = found.select(
        "uri", *features, html_text.absolute_links(F.col("_base"), F.col("_hrefs")).alias("_links")
    )
    return write_uri_table(table, "links", buckets)


def page_table(snapshot: DataFrame) -> UriTable:
    """The pages that count as fetched, one per URI, ready for any number of crawls."""
    pages = one_per_uri(successful(snapshot))
    return write_uri_table(pages, "pages", _buckets(pages))


def outgoing(links: UriTable, frontier: DataFrame, follows: Column) -> DataFrame:
    """(src_uri, depth, uri): the links to follow from the pages of a frontier."""
    pages = links.holding(frontier).join(frontier, "uri").filter(follows)
    return pages.select(
        F.col("uri").alias("src_uri"), "depth", F.explode("_links").alias("uri")
    )


def weighted_crawl(
    snapshot: DataFrame, seeds: list[str] | DataFrame, max_depth: int, score: Column,
    crawl_tag: str, crawl_timestamp: Column | str, now: Column | str,
    features: Mapping[str, Column] | None = None,
    link_filter: Callable[[Column], Column] | None = None,
    history: DataFrame | None = None,
) -> WeightedCrawl:
    """Crawl from the seeds, deciding page by page what to store and what to follow.

    ``score`` may use ``uri``, ``depth`` and the names in ``features``, which are
    expressions over the snapshot's columns and are evaluated once per page. A positive
    score stores the page and follows its links, zero only follows, a negative one does
    neither. ``link_filter`` is a predicate on a URI (null counts as false) that seeds
    must pass as well. Links to another host start there at depth 0, once they have
    passed the gate at one level below their page. Each URI is attempted once per run.
    """
    spark = snapshot.sparkSession
    snapshot = one_per_uri(successful(snapshot))
    features = dict(features or {})
    taken = {*snapshot.columns, "depth", "level", "score"} & set(features)
    if taken:
        raise ValueError(f"features may not be named {sorted(taken)}")
    links = _link_table(snapshot, features, _buckets(snapshot))
    fresh = None
    if history is not None:
        # Written once, so that the levels do not scan the history again and again.
        fresh = written(recently_stored(history, crawl_tag, now).distinct(), "fresh")
    follows = (score >= 0) & (F.col("depth") < max_depth)
    link_depth = hop_depth(F.col("src_uri"), F.col("uri"), F.col("depth")).alias("depth")
    allowed_link = (
        None if link_filter is None
        else F.coalesce(link_filter(F.col("uri")), F.lit(False))
    )

    def gate(candidates: DataFrame) -> DataFrame:
        """One row per URI that may be attempted, with its smallest depth."""
        allowed = candidates if allowed_link is None else candidates.filter(allowed_link)
        once = allowed.groupBy("uri").agg(F.min("depth").alias("depth"))
        return once if fresh is None else once.join(fresh, "uri", "left_anti")

    seed_rows = _seed_rows(spark, seeds)
    levels = Levels(spark, "weighted", links.buckets)
    size = levels.add(gate(seed_rows.select("uri", F.lit(0).alias("depth")))) if (
        max_depth >= 0
    ) else 0
    while size:
        found = outgoing(links, levels.newest(), follows)
        size = levels.add(levels.unvisited(gate(found.select("uri", link_depth))))

    attempted = levels.visited() if levels.depth else seed_rows.select(
        "uri", F.lit(0).alias("depth"), F.lit(0).alias("level")
    ).limit(0)
    # Scores come from the link table; bodies are fetched for the stored pages only.
    known = attempted.join(links.read().drop("_links"), "uri")
    scored = known.withColumn("score", score.cast("double")).select(
        *attempted.columns, "score"
    )
    stored = stamp_pages(
        fetch_existing(scored.filter(F.col("score") > 0), snapshot),
        crawl_tag, crawl_timestamp, now, F.col("score"),
    )
    return WeightedCrawl(
        stored=stored,
        attempted=attempted,
        scored=scored.select(
            "uri", "depth", "level", "score", relevance(F.col("score")).alias("relevance")
        ),
    )


def _seed_rows(spark: SparkSession, seeds: list[str] | DataFrame) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select("uri")
    return spark.createDataFrame([(uri,) for uri in seeds], "uri string")


_PLACE = "array<struct<ord:int,uri:string>>"


def directed_crawl(
    snapshot: DataFrame | UriTable, seeds: list[str] | DataFrame, steps: list[Step],
    crawl_tag: str, crawl_timestamp: Column | str, now: Column | str,
) -> DataFrame:
    """Crawl along a tree of link steps; returns every attempted page, failed ones too.

    The first step to reach a URI decides what happens there. First means in queue
    order: by the page that linked to it, then by step, then by URI. That order is kept
    as the row's ``place``, which grows by one entry per level of the step tree. As many
    levels run as the tree is deep, plus one.

    Pages are looked up in a table bucketed by URI, of which a level reads the files that
    can hold its pages. A :func:`page_table` made beforehand serves several crawls.
    """
    pages = snapshot if isinstance(snapshot, UriTable) else page_table(snapshot)
    spark = pages.spark
    numbered = numbered_steps(steps)
    seed_rows = _seed_rows(spark, seeds).distinct()
    levels = Levels(spark, "directed", pages.buckets)
    size = levels.add(
        seed_rows.select(
            "uri",
            F.lit(ROOT_STEP).alias("step_id"),
            F.array(F.struct(F.lit(0).alias("ord"), F.col("uri"))).cast(_PLACE).alias("place"),
        )
    )
    parents = [ROOT_STEP]
    while size:
        # Only the steps below this level's steps can apply to its pages; pages at the
        # end of their branch have no links to look for.
        active = [entry for entry in numbered if entry.parent_step_id in parents]
        if not active:
            break
        branching = levels.newest().filter(
            F.col("step_id").isin(sorted({entry.parent_step_id for entry in active}))
        )
        parents = [entry.step_id for entry in active]
        bodies = pages.holding(branching).select("uri", "body").join(branching, "uri")
        found = step_links(
            with_nodes(bodies, "body"), active, "place", uri="uri", active="step_id"
        )
        placed = found.select(
            F.col("dst_uri").alias("uri"),
            F.struct(
                F.concat(
                    "place", F.array(F.struct(F.col("ord"), F.col("dst_uri").alias("uri")))
                ).cast(_PLACE).alias("place"),
                F.col("step_id"),
            ).alias("found"),
        )
        first = placed.groupBy("uri").agg(F.min("found").alias("found")).select(
            "uri", "found.step_id", "found.place"
        )
        size = levels.add(levels.unvisited(first))

    attempted = levels.visited().select("uri", "step_id", "level")
    return stamp_pages(
        fetch(attempted, pages.holding(attempted)), crawl_tag, crawl_timestamp, now
    )
