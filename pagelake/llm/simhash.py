"""Near duplicates by SimHash fingerprints and pigeonring filtering.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the hashes of the text's
word shingles, repeats included. Fingerprints link if at most ``radius`` bits differ.

Candidates come from the pigeonring principle: cut both fingerprints into m segments on a
ring and let d_j be the bits that differ in segment j. If all of them sum to at most r,
there is a segment i from which *every* chain of consecutive segments stays within its
proportional budget: d_i + ... + d_{i+l-1} <= l * r / m for l = 1 ... m. So a pair shares,
for some i, the first segment within its budget and the first two segments within theirs.
These two are the key of a join, the differences that the budgets allow being spelled out
on one side; longer chains, and at last the whole distance, are checked in the join's
condition. All 64-bit texts with the same fingerprint are one row throughout.

Linked fingerprints are grouped by contraction: each takes its smallest neighbour's place,
in an order made random by hashing, until no link is left between different places.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.tables import LOWER, UPPER, discard, free_name, settle
from pagelake.operators.ordering import number_all

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
RADIUS = 3
SEGMENTS = 4


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    # On bytes, lower() changes A-Z only and split() cuts at ASCII white space only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1:] - 1).tolist()
    return np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64
    )


def simhash(text: str | None, width: int) -> int:
    """The fingerprint of a text; 0 if it has no word."""
    hashes = shingle_hashes(text, width)
    bits = np.unpackbits(
        hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    over_half = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int) -> Column:
    """The fingerprint of a text as a bigint with the same 64 bits."""

    @F.arrow_udf("bigint")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [simhash(text.as_py(), width) for text in batch]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(text)


def _budgets(radius: int, segments: int) -> list[int]:
    """The whole bits that chains of 1, 2, ... segments may differ in."""
    return [length * radius // segments for length in range(1, segments + 1)]


def _key_differences(radius: int, segments: int) -> list[int]:
    """Differences of two neighbouring segments that keep both chains within budget."""
    width = BITS // segments
    one, two = _budgets(radius, segments)[:2]
    places = range(2 * width)
    found = []
    for count in range(two + 1):
        for chosen in combinations(places, count):
            # The first segment takes the upper half of the key.
            if sum(place >= width for place in chosen) <= one:
                found.append(sum(1 << place for place in chosen))
    return found


def _segments_of(value: Column, segments: int) -> list[Column]:
    width = BITS // segments
    mask = F.lit((1 << width) - 1).cast("bigint")
    return [
        F.shiftrightunsigned(value, width * at).bitwiseAND(mask) for at in range(segments)
    ]


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``fp`` that differ in at most ``radius`` bits."""
    width = BITS // segments
    parts = _segments_of(F.col("fp"), segments)
    keys = F.array(*[
        F.shiftleft(parts[at], width).bitwiseOR(parts[(at + 1) % segments])
        for at in range(segments)
    ])
    homes = prints.select(F.col("fp").alias("b"), F.posexplode(keys).alias("at", "key"))
    differences = F.array(
        *[F.lit(d).cast("bigint") for d in _key_differences(radius, segments)]
    )
    probes = (
        prints.select(F.col("fp").alias("a"), F.posexplode(keys).alias("at", "own"))
        .select("a", "at", "own", F.explode(differences).alias("difference"))
        .select("a", "at", F.col("own").bitwiseXOR(F.col("difference")).alias("key"))
    )
    apart = F.col("a").bitwiseXOR(F.col("b"))
    counts = [F.bit_count(part) for part in _segments_of(apart, segments)]
    start = None
    for at in range(segments - 1, -1, -1):
        holds, chain = F.lit(True), F.lit(0)
        for length, budget in enumerate(_budgets(radius, segments)):
            chain = chain + counts[(at + length) % segments]
            holds = holds & (chain <= budget)
        start = F.when(holds, at) if start is None else F.when(holds, at).otherwise(start)
    # The first start from which all chains hold; each pair is found there alone. Sizes are
    # estimated without the explosion, so the probes must be kept from being broadcast.
    return probes.hint("merge").alias("p").join(
        homes.alias("h"),
        (F.col("p.at") == F.col("h.at")) & (F.col("p.key") == F.col("h.key"))
        & (F.col("a") < F.col("b")) & (F.col("p.at") == start)
        & (F.bit_count(apart) <= radius),
    ).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes of a component share a root.

    The root is the node of smallest hash. Each round every place moves to its smallest
    neighbour's, twice over, and links within a place vanish.
    """
    edges = settle(
        edges.select(F.struct(F.xxhash64("a").alias("o"), F.col("a").alias("n")).alias("a"),
                     F.struct(F.xxhash64("b").alias("o"), F.col("b").alias("n")).alias("b")),
        "links",
    )
    nodes = edges.select("a").union(edges.select("b")).distinct()
    roots = settle(nodes.select(F.col("a").alias("node"), F.col("a").alias("root")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(
            both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")), "parents"
        )
        above = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
        jump = settle(
            parent.join(above, "up").select("a", F.col("top").alias("up")), "parents"
        )
        of_b = jump.select(F.col("a").alias("b"), F.col("up").alias("up_b"))
        moved = edges.join(jump, "a").join(of_b, "b").select(
            F.least("up", "up_b").alias("a"), F.greatest("up", "up_b").alias("b")
        )
        old_edges, old_roots = edges, roots
        edges = settle(moved.where("a != b").distinct(), "links")
        of_root = jump.select(F.col("a").alias("root"), F.col("up"))
        roots = settle(
            roots.join(of_root, "root", "left")
            .select("node", F.coalesce("up", "root").alias("root")),
            "roots",
        )
        discard(old_edges, old_roots, parent, jump)
    discard(edges)
    return roots.select(F.col("node.n").alias("node"), F.col("root.n").alias("root"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3,
    radius: int = RADIUS, segments: int = SEGMENTS,
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is a bigint of 64 bits. ``component_id`` is the smallest key among all
    rows that links reach, the row itself included; it is null only if all their keys are.
    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows
    have equal results. An empty table gives an empty table.
    """
    prints = settle(
        docs.select(F.col(key).alias("id"), fingerprint(F.col(text), width).alias("fp")),
        "fingerprints",
    )
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    grouped = components(links(distinct.select("fp"), radius, segments))
    placed = settle(
        distinct.join(grouped, F.col("fp") == F.col("node"), "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "placed",
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = settle(placed.join(smallest, "root").select("fp", "component_id"), "classes")
    discard(distinct, placed)
    return prints.join(classes, "fp").select(
        F.col("id").alias(key), F.col("fp").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3,
    radius: int = RADIUS, segments: int = SEGMENTS,
) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`, other rows go.

    The row with the smallest key stays, one without a key only where no other has one; of
    several such rows (repeated rows, rows that share a key) any one. Components come from
    the fingerprints alone, so different texts with one key, or none, are told apart. Null,
    empty and blank texts are one component with all fingerprints near zero. An empty table
    gives an empty table. Which row stays is decided on places and keys: texts are not
    aggregated, and no component is brought into one task.
    """
    place, print_of = free_name(docs, "place"), free_name(docs, "fp")
    rows = settle(
        docs.select(
            "*", F.monotonically_increasing_id().alias(place),
            fingerprint(F.col(text), width).alias(print_of),
        ),
        "rows",
    )
    prints = rows.select(
        F.col(key).alias("id"), F.col(print_of).alias("fp"), F.col(place).alias("at")
    )
    # Nulls sort first in a struct, so whether the key is missing comes before it.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("best")
    distinct = settle(prints.groupBy("fp").agg(best), "distinct")
    grouped = components(links(distinct.select("fp"), radius, segments))
    chosen = settle(
        distinct.join(grouped, F.col("fp") == F.col("node"), "left")
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
        .select(F.col("best.at").alias(place)),
        "chosen",
    )
    discard(distinct)
    return rows.join(chosen, place, "left_semi").select(*[f"`{name}`" for name in docs.columns])
