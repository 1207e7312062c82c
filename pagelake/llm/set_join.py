"""Documents whose sets of word shingles are similar, joined exactly with skipping.

Two sets link if their Jaccard similarity is at least ``percent`` hundredths; documents are
grouped by links. Sets with equal elements are one set from the start.

*Index.* All sets order their elements alike: rare before frequent ones, by hash within
both. Two similar sets share an element among the first few of each (their *prefixes*), so
the index lists, for each element, the sets that have it in their prefix, with size and
position. Frequent are the elements of more than ``FREQUENT`` beginnings; a set whose
beginning is full of them is looked at whole.

*Skipping by position.* For the first element that two sets share, at positions p and q,
nothing before is shared: p + q elements are lost already, and the rest differ at least as
much as their numbers do. A pair is similar only if that stays within the difference its
sizes allow. Long lists are cut into blocks by size and position, and a set visits only
blocks for which the bounds can hold. Pairs that are left compare the numbers of elements
in ranges of the hash (positions at fixed quantiles) before any set is read.

*Answers from answers.* In long lists only a few sets, the heads, meet the whole list: the
least lonely, whose elements are in most other sets. A text that many were made from has few
of its own, so it comes first and most of its copies are near it; a copy far from it would
lead but a part of them, and the parts would be paired off. What a head shares with a set near it is kept as the two small differences between them,
and the head leads that set. Two sets with one leader are not paired off in any list: what
they share follows from their differences, so these are indexed in turn, within each
leader's sets. Two sets that differ from the leader in other elements are no nearer to each
other than to the leader, so a link beside the leader's own takes common differences, most
of them for sets far from it, and again the first one in a common order, rare before
frequent, must come early in both. Heads grow in number until every pair of a list is
settled.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.debruijn import _WORD_STEP, Words, _groups, _mix, _runs
from pagelake.llm.simhash import components
from pagelake.llm.tables import discard, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Beginnings that an element may be in and still count as rare.
FREQUENT = 32
#: Sets that an index list may hold and still be paired off at once.
SHORT = 32
#: Rows up to which a table of frequent elements is broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
#: Ranges of the hash whose numbers of elements are compared.
RANGES = 32
#: Blocks by position of a long list, and how many times a similar set's reach the sizes of a
#: block are apart; growth of the heads from round to round.
BLOCKS = 8
SIZE_STEPS = 2
#: Long lists of each set in which the first leaders are looked for.
PROBED = 4
GROWTH = 32
#: Similarity, in hundredths, from which a set counts as near a head.
NEAR = 50

_LEAST = -(1 << 63)
IDENTITY = ["key", "t1", "t2"]

_LONGS = T.ArrayType(T.LongType(), False)
SETS = T.StructType([
    T.StructField("n", T.LongType(), False), T.StructField("s1", T.LongType(), False),
    T.StructField("s2", T.LongType(), False), T.StructField("head", _LONGS, False),
    T.StructField("profile", T.BinaryType(), False),
])
COMPARED = T.StructType([
    T.StructField("shared", T.LongType(), False), T.StructField("lacks", _LONGS, True),
    T.StructField("adds", _LONGS, True),
])


# --- sets of texts ------------------------------------------------------------------------

def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, A-Z in lower case."""
    for _, group in _groups(texts):
        # On bytes, lower() changes A-Z only.
        words = Words([text.lower() for text in group])
        runs, _ = words.windows(width)
        for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if last - first >= width:
                yield np.unique(runs[first:last - width + 1])
            else:
                few = words.hashes[first:last]
                yield _runs(few, np.array([0]), np.array([len(few)]), _WORD_STEP)[:len(few)]


def prefix_size(n, percent: int):
    """Elements of a set among which a similar set of any size has one, too."""
    return n + (-percent * n) // 100 + 1


def _long_list(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([v.view(np.int64) for v in values] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat), type=pa.list_(pa.field("element", pa.int64(), False))
    )


def _sets(text: Column, width: int, percent: int) -> Column:
    """Size, 128 bits of hash, beginning (two prefixes long) and profile of a text's set."""

    @F.arrow_udf(SETS)
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.collect()  # what tasks before this one left in the worker
        bounds = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)
        for batch in batches:
            sizes, firsts, seconds, heads, profiles = [], [], [], [], []
            for one in shingle_sets(batch.to_pylist(), width):
                sizes.append(len(one))
                firsts.append(one.sum(dtype=np.uint64))
                seconds.append(_mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                heads.append(one[:2 * prefix_size(len(one), percent)])
                cuts = np.concatenate(([0], np.searchsorted(one, bounds), [len(one)]))
                profiles.append(np.diff(cuts).astype("<u4").tobytes())
            arrays = [
                pa.array(sizes, pa.int64()),
                pa.array(np.array(firsts, np.uint64).view(np.int64)),
                pa.array(np.array(seconds, np.uint64).view(np.int64)),
                _long_list(heads), pa.array(profiles, pa.binary()),
            ]
            yield pa.StructArray.from_arrays(arrays, fields=[
                pa.field(field.name, array.type, False)
                for field, array in zip(SETS.fields, arrays)
            ])

    return sets(text)


def _whole(text: Column, width: int) -> Column:
    @F.arrow_udf(_LONGS)
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.collect()
        for batch in batches:
            yield _long_list(list(shingle_sets(batch.to_pylist(), width)))

    return whole(text)


def whole_sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, elements) of ``nodes`` (node and IDENTITY), from the rows' texts."""
    texts = rows.join(nodes.select("node", *IDENTITY), IDENTITY).select("node", "text")
    return settle(
        texts.dropDuplicates(["node"]).select("node", _whole(F.col("text"), width).alias("elements")),
        "elements",
    )


# --- bounds -------------------------------------------------------------------------------

def _allowed(n: Column, m: Column, percent: int) -> Column:
    """Elements in which similar sets of these sizes may differ."""
    overlap = F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)
    return n + m - 2 * overlap


def _possible(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Whether sets of sizes n and m, first meeting at positions p and q, can be similar."""
    left = _allowed(n, m, percent) - (p + q)
    return (left >= 0) & (F.abs((n - p) - (m - q)) <= left)


def _alike(one: Column, other: Column, allowed: Column) -> Column:
    """Whether two profiles differ by no more than allowed."""

    @F.arrow_udf("boolean")
    def alike(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]
    ) -> Iterator[pa.Array]:
        for a, b, most in batches:
            left, right = (
                np.frombuffer(b"".join(x.to_pylist()), "<u4").reshape(-1, RANGES).astype(np.int64)
                for x in (a, b)
            )
            yield pa.array(np.abs(left - right).sum(axis=1) <= most.to_numpy(zero_copy_only=False))

    return alike(one, other, allowed)


# --- comparisons --------------------------------------------------------------------------

def _compared(one: Column, other: Column) -> Column:
    """What two sets share; for near ones also what the first lacks and adds to the second."""

    @F.arrow_udf(COMPARED)
    def compared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        gc.collect()
        for left, right in batches:
            rows = []
            for a, b in zip(left, right):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (a, b))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near = 100 * shared >= NEAR * (len(a) + len(b) - shared)
                rows.append({
                    "shared": shared,
                    "lacks": np.setdiff1d(b, a, True).view(np.int64) if near else None,
                    "adds": np.setdiff1d(a, b, True).view(np.int64) if near else None,
                })
            longs = pa.list_(pa.field("element", pa.int64(), False))
            yield pa.array(rows, pa.struct([
                pa.field("shared", pa.int64(), False), pa.field("lacks", longs),
                pa.field("adds", longs),
            ]))

    return compared(one, other)


def _derived(size: Column, *differences: Column) -> Column:
    """What two sets share, from the size of the head near both and their differences.

    Of the head's elements both have all but those that either lacks; beside them they
    share what both add.
    """
    lacks, adds, other_lacks, other_adds = differences
    return (
        size - F.size(lacks) - F.size(other_lacks)
        + F.size(F.array_intersect(lacks, other_lacks))
        + F.size(F.array_intersect(adds, other_adds))
    ).cast("bigint")


class _Verifier:
    """Exact overlaps of pairs (a, n, b, m), from ``profiles`` and ``elements`` of the sets."""

    def __init__(self, profiles: DataFrame, elements: DataFrame | None, percent: int):
        self.profiles, self.elements, self.percent = profiles, elements, percent

    def similar(self) -> Column:
        return 100 * F.col("shared") >= self.percent * (F.col("n") + F.col("m") - F.col("shared"))

    def likely(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs whose profiles allow a similarity of ``percent`` hundredths."""
        allowed = _allowed(F.col("n"), F.col("m"), percent)
        a, b = (self.profiles.select("node", "profile").toDF(x, f"of_{x}") for x in "ab")
        return settle(
            pairs.join(a, "a").join(b, "b").where(_alike(F.col("of_a"), F.col("of_b"), allowed))
            .select("a", "n", "b", "m"),
            "likely",
        )

    def compare(self, pairs: DataFrame, keep: bool) -> DataFrame:
        """``pairs`` with what they share, and, to ``keep``, the differences of near ones."""
        a, b = (self.elements.toDF(x, f"of_{x}") for x in "ab")
        return settle(
            pairs.join(a, "a").join(b, "b")
            .select("a", "n", "b", "m", _compared(F.col("of_a"), F.col("of_b")).alias("c"))
            .select("a", "n", "b", "m", "c.shared", *(["c.lacks", "c.adds"] if keep else [])),
            "compared",
        )


# --- the index ----------------------------------------------------------------------------

def _against(rows: DataFrame, elements: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with a table of elements, broadcast if it is known to be small."""
    small = elements.count() <= BROADCAST_ROWS
    return rows.join(elements.hint("broadcast" if small else "merge"), "element", how)


def _ordered(sets: DataFrame, elements: str, frequent: DataFrame, percent: int) -> DataFrame:
    """``sets`` with ``prefix``: the rare of ``elements`` first, and ``n_rare`` of them."""
    places = _against(
        sets.select("node", F.posexplode(elements).alias("at", "element")), frequent, "left_semi"
    ).groupBy("node").agg(F.collect_list("at").alias("marked"))
    marked = F.coalesce("marked", F.array().cast("array<int>"))
    rare = F.array_except(F.sequence(F.lit(0), F.size(elements) - 1), marked)
    order = F.slice(
        F.concat(rare, F.array_sort(marked)), F.lit(1), F.col("wanted").cast("int")
    )
    return (
        sets.withColumn("wanted", prefix_size_of(F.col("n"), percent))
        .join(places, "node", "left")
        .withColumn("prefix", F.transform(order, lambda at: F.get(F.col(elements), at)))
        .withColumn("n_rare", F.size(elements) - F.size(marked))
    )


def prefix_size_of(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / F.lit(100.0) - 1e-9) + 1


def index(
    rows: DataFrame, sets: DataFrame, width: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """(element, node, n, pos): the prefixes of all sets in the common order; and (node,
    elements) of the sets that were looked at whole."""
    frequent = settle(
        sets.select(F.explode("head").alias("element")).groupBy("element")
        .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > FREQUENT).select("element"),
        "frequent",
    )
    first = settle(
        _ordered(sets.select("node", "n", *IDENTITY, "head"), "head", frequent, percent)
        .withColumn(
            "done", (F.col("n_rare") >= F.col("wanted")) | (F.size("head") == F.col("n"))
        ).select("node", "n", *IDENTITY, "prefix", "done"),
        "prefixes",
    )
    # Beginnings full of frequent elements: their rare ones may come anywhere.
    open_sets = first.where("NOT done")
    elements = whole_sets(rows, open_sets, width)
    rest = _ordered(elements.join(open_sets.select("node", "n"), "node"), "elements", frequent, percent)
    found = settle(
        first.where("done").select("node", "n", "prefix")
        .unionByName(rest.select("node", "n", "prefix"))
        .select("node", "n", F.posexplode("prefix").alias("pos", "element")),
        "postings",
    )
    discard(frequent, first)
    return found, elements


def _short_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, n, b, m): the possible pairs within each list; the smaller set is a."""
    a = postings.select("element", F.col("node").alias("a"), "n", F.col("pos").alias("p"))
    b = postings.select(
        "element", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q")
    )
    order = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    sizes = F.col("n") * 100 >= F.col("m") * percent
    # Sizes are estimated without the explosion, so neither side may be broadcast.
    return a.hint("merge").join(b, "element").where(
        order & sizes & _possible(F.col("n"), F.col("p"), F.col("m"), F.col("q"), percent)
    ).select("a", "n", "b", "m").distinct()


def _blocked(postings: DataFrame, percent: int) -> DataFrame:
    """Postings with their block: sizes within a similar set's reach differ by one at most."""
    step = F.lit(SIZE_STEPS * float(np.log(100.0 / percent)) * (1 + 1e-9))
    return postings.select(
        "element", "node", "n", "pos",
        F.floor(F.log(F.col("n")) / step).cast("int").alias("size_block"),
        F.least(F.lit(BLOCKS - 1), F.floor(
            F.col("pos") * BLOCKS / (F.col("n") * ((100.0 - percent) / percent) + 1)
        )).cast("int").alias("pos_block"),
    )


def _lonely(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(node, lonely): how few of ``nodes`` the elements of each are in, on average.

    An element that ``count`` sets have adds its share of them, in millionths so that the
    sum is the same in any order.
    """
    single = elements.join(nodes, "node", "left_semi").select(
        "node", F.explode("elements").alias("element")
    )
    shares = single.groupBy("element").agg(
        F.floor(F.lit(1e6) / F.count(F.lit(1))).alias("share")
    )
    return settle(
        single.join(shares, "element").groupBy("node")
        .agg((F.sum("share") / F.count(F.lit(1))).alias("lonely")),
        "lonely",
    )


def _led(compared: DataFrame, left: DataFrame) -> DataFrame:
    """(node, leader, size, n, lacks, adds): new leaders and the sets near them.

    Only a set without a leader comes to lead, and only such sets are led. Of heads that are
    near each other the least lonely leads.
    """
    free = left.where("leader IS NULL").select("node", "order").distinct()
    asked = compared.select(F.col("b").alias("node"), F.col("m").alias("n")).distinct().join(
        free, "node"
    )
    first, second = (
        asked.select(F.col("node").alias(x), F.col("order").alias(f"order_{x}")) for x in "ba"
    )
    behind = (
        compared.where("lacks IS NOT NULL").select("a", "b").join(first, "b").join(second, "a")
        .where("order_b < order_a").select(F.col("a").alias("node"))
    )
    heads = settle(asked.drop("order").join(behind, "node", "left_anti"), "heads")
    best = F.max_by(
        F.struct(F.col("b").alias("leader"), F.col("m").alias("size"), "n", "lacks", "adds"),
        F.struct("shared", -F.col("b")),
    )
    members = (
        compared.where("lacks IS NOT NULL").join(heads.select(F.col("node").alias("b")), "b", "left_semi")
        .join(free.select(F.col("node").alias("a")), "a", "left_semi")
        .join(heads.select(F.col("node").alias("a")), "a", "left_anti")
        .groupBy(F.col("a").alias("node")).agg(best.alias("best")).select("node", "best.*")
    )
    nothing = F.array().cast("array<bigint>")
    own = heads.select(
        "node", F.col("node").alias("leader"), F.col("n").alias("size"), "n",
        nothing.alias("lacks"), nothing.alias("adds"),
    )
    led = settle(members.unionByName(own), "led")
    discard(heads)
    return led


def _long_links(
    postings: DataFrame, verifier: _Verifier, percent: int
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b) among the sets of each list, but those between sets of one leader; and
    the sets that are led."""
    found: list[DataFrame] = []
    led: list[DataFrame] = []
    own_lists = W.partitionBy("node").orderBy("pos")
    lonely = _lonely(postings.select("node").distinct(), verifier.elements)
    left = settle(
        _blocked(postings, percent).withColumn("leader", F.lit(None).cast("bigint"))
        .withColumn("nth", F.row_number().over(own_lists)).join(lonely, "node")
        .withColumn("order", F.struct("lonely", F.xxhash64("node").alias("hash")))
        .drop("lonely"),
        "left",
    )
    discard(lonely)
    count, salt, probing = 1, 0, True
    while not left.isEmpty():
        # Copies of one text meet in most of their lists, of which a few find them a leader;
        # then the lists in which all have the same one are done.
        seen = left.where(F.col("nth") <= PROBED) if probing else left
        bucket = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(count)).alias("bucket")
        chosen = F.min(F.struct(
            F.col("leader").isNotNull().alias("has"), "order",
            F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"),
            F.col("pos_block").alias("head_block"), F.col("leader").alias("of_leader"),
        )).alias("head")
        heads = settle(
            seen.groupBy("element", "size_block", bucket).agg(chosen)
            .select("element", "size_block", "head.*").drop("has", "order"),
            "heads",
        )
        # A head goes to the blocks of its own and the neighbouring sizes and of all
        # positions that it can meet; the others are skipped.
        reach = F.explode(F.array(*[F.col("size_block") + step for step in (-1, 0, 1)]))
        visits = heads.withColumn("size_block", reach).withColumn(
            "pos_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS) - F.col("head_block")))
        )
        pairs = settle(
            seen.hint("merge").join(visits, ["element", "size_block", "pos_block"])
            .where("node != b AND NOT coalesce(leader = of_leader, false)")
            .where(_possible(F.col("n"), F.col("pos"), F.col("m"), F.col("q"), percent))
            .select(F.col("node").alias("a"), "n", "b", "m").distinct(),
            "pairs",
        )
        likely = verifier.likely(pairs, NEAR)
        compared = verifier.compare(likely, keep=True)
        new_led = _led(compared, left)
        led.append(new_led)
        found.append(settle(compared.where(verifier.similar()).select("a", "b"), "found"))
        # A head that has met its whole list is done with there.
        met = heads.select("element", F.col("b").alias("node"))
        rest = settle(
            (left if probing else left.join(met, ["element", "node"], "left_anti"))
            .join(new_led.select("node", F.col("leader").alias("new")), "node", "left")
            .withColumn("leader", F.coalesce("leader", "new")).select(*left.columns),
            "rest",
        )
        # A list is done when all its sets have one leader.
        group = F.struct(
            F.col("leader").isNull().alias("alone"), F.coalesce("leader", "node").alias("of")
        )
        mixed = rest.groupBy("element").agg(
            F.min(group).alias("first"), F.max(group).alias("last")
        ).where("first < last").select("element")
        new = settle(rest.join(mixed, "element", "left_semi"), "left")
        discard(left, heads, pairs, likely, compared, rest)
        left, probing = new, False
        if salt:
            count *= GROWTH
        salt += 1
    discard(left)
    return found, led


def _differences_of(led: DataFrame, verifier: _Verifier) -> DataFrame:
    """Links (a, b) between sets of one leader, other than those with the leader itself.

    Sets that link with the leader are connected by it, so one of the two is a set that does
    not: it is far. Links take so many common differences that the
    first of them in the common order, at p and q, leaves room for the others behind it.
    """
    percent = verifier.percent
    own = led.where("node != leader").withColumn("shared", F.col("size") - F.size("lacks")).withColumn(
        "far", 100 * F.col("shared") < percent * (F.col("n") + F.col("size") - F.col("shared"))
    )
    tagged = settle(
        own.select("node", "leader", "n", "far", F.concat(
            F.transform("lacks", lambda x: F.struct(x.alias("x"), F.lit(False).alias("added"))),
            F.transform("adds", lambda x: F.struct(x.alias("x"), F.lit(True).alias("added"))),
        ).alias("differences")),
        "differences",
    )
    single = tagged.select("node", "leader", F.explode("differences").alias("t"))
    counts = single.groupBy("leader", "t").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    # Differences that no other set has come first in the order and meet nothing.
    shared = single.join(counts, ["leader", "t"]).groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("count", "t"))).alias("order")
    )
    placed = settle(
        tagged.select("node", "leader", "n", "far", F.size("differences").alias("d"))
        .join(shared, "node").withColumn("alone", F.col("d") - F.size("order"))
        .select("node", "leader", "n", "far", "d", "alone", F.posexplode("order").alias("at", "o"))
        .select("leader", "o.t", "node", "n", "far", "d", (F.col("alone") + F.col("at")).alias("p")),
        "placed-differences",
    )
    a = placed.toDF("leader", "t", "a", "n", "far", "d", "p")
    b = placed.toDF("leader", "t", "b", "m", "far_b", "e", "q")
    # Both lack or add: what they do not have in common tells them apart.
    needed = F.ceil((F.col("d") + F.col("e") - _allowed(F.col("n"), F.col("m"), percent)) / F.lit(2.0))
    early = (F.col("p") <= F.col("d") - needed) & (F.col("q") <= F.col("e") - needed)
    twice = F.col("far_b") & (F.col("a") > F.col("b"))
    pairs = (
        a.where("far").hint("merge").join(b, ["leader", "t"])
        .where((F.col("a") != F.col("b")) & ~twice & early).select("a", "b").distinct()
    )
    sides = led.select("node", "size", "n", "lacks", "adds")
    known = pairs.join(sides.toDF("a", "size", "n", "lacks_a", "adds_a"), "a").join(
        sides.toDF("b", "size_b", "m", "lacks_b", "adds_b"), "b"
    ).withColumn("shared", _derived(
        F.col("size"), F.col("lacks_a"), F.col("adds_a"), F.col("lacks_b"), F.col("adds_b")
    ))
    found = settle(known.where(verifier.similar()).select("a", "b"), "found")
    discard(tagged, placed)
    return found


def _roots(links: list[DataFrame]) -> DataFrame:
    """(node, root) of everything that ``links`` connect."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return components(edges)


# --- the operator -------------------------------------------------------------------------

def similar_sets(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3,
    percent: int = 90,
) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    ``n_shingles`` is the number of distinct shingles of ``width`` words; a text with fewer
    words is one shingle, a text without words (null, empty, blank) has none and links with
    nothing. ``component_id`` is the smallest key among all rows that links reach, the row
    itself included; it is null only if all their keys are. Keys are whole numbers. Rows are
    told apart by their texts, so different texts with one key, or none, are different sets;
    repeated rows have equal results. An empty table gives an empty table.
    """
    least = F.lit(_LEAST)
    rows = docs.select(
        F.coalesce(F.col(key).cast("bigint"), least).alias("key"),
        F.xxhash64(F.col(text)).alias("t1"),
        F.xxhash64(F.lit("text"), F.col(text)).alias("t2"), F.col(text).alias("text"),
    )
    prints = settle(
        rows.select(
            *IDENTITY, F.monotonically_increasing_id().alias("node"),
            _sets(F.col("text"), width, percent).alias("s"),
        ).select(*IDENTITY, "node", "s.*"),
        "sets",
    )
    same = ["n", "s1", "s2"]
    classes = settle(
        prints.where("n > 0").groupBy(*same).agg(
            F.min("node").alias("node"),
            F.min(F.when(F.col("key") != least, F.col("key"))).alias("first"),
        ),
        "classes",
    )
    sets = settle(
        prints.select("node", *IDENTITY, "n", "head", "profile")
        .join(classes.select("node"), "node", "left_semi"),
        "distinct",
    )
    results = settle(prints.select("key", *same), "results")
    discard(prints)
    postings, whole = index(rows, sets, width, percent)
    profiles = settle(sets.drop("head"), "profiles")
    discard(sets)
    frequent = settle(
        postings.groupBy("element").agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > SHORT).select("element"),
        "long",
    )
    long = settle(_against(postings, frequent, "left_semi"), "long")
    pairs = settle(_short_pairs(_against(postings, frequent, "left_anti"), percent), "pairs")
    discard(postings, frequent)
    verifier = _Verifier(profiles, None, percent)
    short = verifier.likely(pairs, percent)
    discard(pairs)
    # All sets that are compared are read from their texts, once.
    asked = long.select("node").union(short.select("a")).union(short.select("b")).distinct()
    others = whole_sets(
        rows, profiles.join(asked, "node", "left_semi").join(whole, "node", "left_anti"), width
    )
    verifier.elements = whole.unionByName(others)
    links, led = _long_links(long, verifier, percent)
    discard(long)
    pairs = short
    if led:
        near = settle(reduce(DataFrame.unionByName, led), "near")
        links.append(_differences_of(near, verifier))
        # Pairs with one leader have been decided.
        leaders = near.select("node", "leader")
        pairs = (
            short.join(leaders.toDF("a", "leader_a"), "a", "left")
            .join(leaders.toDF("b", "leader_b"), "b", "left")
            .where("NOT coalesce(leader_a = leader_b, false)").select(*short.columns)
        )
    compared = verifier.compare(pairs, keep=False)
    links.append(compared.where(verifier.similar()).select("a", "b"))
    grouped = _roots(links)
    placed = settle(
        classes.join(grouped, "node", "left")
        .select(*same, "first", F.coalesce("root", "node").alias("root")),
        "placed",
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    result = settle(placed.join(smallest, "root").select(*same, "component_id"), "components")
    discard(profiles, short, classes, placed, whole, others, compared, *led, *links[:-1])
    own = F.when(F.col("key") != least, F.col("key"))
    return results.join(result, same, "left").select(
        own.alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"),
    )
