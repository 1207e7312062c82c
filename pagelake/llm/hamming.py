"""Exact top-k search among binary codes by incremental multi-index hashing.

A code is an array of 64-bit words, each cut into ``segments`` equal segments, and each
segment is indexed by its value. A query looks up, segment by segment, all values within a
radius of its own. Two codes that differ in at most ``n * (radius + 1) - 1`` bits, with n
segments in all, agree up to ``radius`` in at least one segment, so once all segments were
searched with a radius, every code within that distance has been seen. Radii grow round by
round, for the queries alone whose k-th best verified distance is not yet within the
distance covered.

Values within a radius are spelled out as long as they are fewer than the values that a
segment has at all; beyond that the segment's own distinct values are gone through, in
blocks, for the distinct values asked for.

Only distinct codes are indexed, each with its k smallest ids: more ids of one code can
never be among the k best. A pair of codes is reported once, in the round and segment where
its segments' smallest difference lies first, and only up to the k-th distance so far.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.tables import discard, settle

BITS = 64
#: Blocks that the distinct values of a segment are dealt to.
BLOCKS = 32


def sign_code(vector: Column) -> Column:
    """The code of a vector: one bit per number, 1 if positive, 64 of them in a word.

    The first number is the highest bit of the first word; the last word is filled up with
    zeros, and an empty vector has one word of them. A null vector has no code.
    """
    def word(number: Column) -> Column:
        numbers = F.slice(vector, number * BITS + 1, BITS)
        bits = F.aggregate(
            numbers, F.lit(0).cast("bigint"),
            lambda code, x: F.shiftleft(code, 1).bitwiseOR(
                F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
            ),
        )
        # A shift takes its distance modulo 64, which a full word does not need.
        return F.call_function("shiftleft", bits, F.lit(BITS) - F.size(numbers))

    last = F.greatest(F.lit(0), F.ceil(F.size(vector) / F.lit(BITS)).cast("int") - 1)
    return F.when(vector.isNotNull(), F.transform(F.sequence(F.lit(0), last), word))


def _segments(code: Column, words: int, segments: int) -> list[Column]:
    """All segments of a code."""
    width = BITS // segments
    mask = F.lit((1 << width) - 1).cast("bigint")
    return [
        F.shiftrightunsigned(F.get(code, F.lit(word)), number * width).bitwiseAND(mask)
        for word in range(words) for number in range(segments)
    ]


def _distance(one: Column, other: Column) -> Column:
    differing = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda total, n: total + n)


def _spelled(asked: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """(segment, own, value): the values asked for that differ in low to high bits."""
    spelled = asked.select("segment", "own", F.explode(_within(low, high, width)).alias("apart"))
    return spelled.select("segment", "own", F.col("own").bitwiseXOR(F.col("apart")).alias("value"))


def _gone_through(asked: DataFrame, values: DataFrame, low: int, high: int) -> DataFrame:
    """The same of those values that there are."""
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    dealt = values.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(BLOCKS)).cast("int"))
    apart = F.bit_count(F.col("own").bitwiseXOR(F.col("value")))
    return asked.select("segment", "own", everywhere).hint("merge").join(
        dealt, ["segment", "block"]
    ).where(apart.between(low, high)).select("segment", "own", "value")


def _within(radius_from: int, radius_to: int, width: int) -> Column:
    """All differences of a segment that have so many bits; a constant."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit((1 << width) - 1).cast("bigint"))
    return F.filter(every, lambda x: F.bit_count(x).between(radius_from, radius_to))


def _distinct_codes(rows: DataFrame, key: str, code: str, k: int) -> DataFrame:
    """(code, id): each code's k smallest ids; ranks are cut before the shuffle."""
    place = F.row_number().over(W.partitionBy("code").orderBy("id"))
    return (
        rows.where(F.col(code).isNotNull())
        .select(F.col(code).alias("code"), F.col(key).alias("id"))
        .withColumn("place", place).where(F.col("place") <= k).drop("place")
    )


def top_k(
    rows: DataFrame, queries: DataFrame, k: int, *, key: str = "id", code: str = "code",
    segments: int = 4,
) -> DataFrame:
    """(query_id, rank, the key, distance): the k rows of ``rows`` nearest to each query.

    Distance is the number of differing bits; ties go to the smaller id, null ids first. A
    query that is also a row finds itself. Repeated rows are found as often as they are
    there. Codes of fewer words than others count as filled up with zeros. Rows and queries
    without a code are not found and find nothing. If there are fewer than k rows, all are
    found. Empty tables give an empty table.
    """
    width = BITS // segments
    spark = rows.sparkSession
    sizes = rows.select(F.size(code).alias("n")).union(queries.select(F.size(code).alias("n")))
    words = max(1, sizes.agg(F.max("n")).first()[0] or 1)
    total = words * segments

    def filled(frame: DataFrame) -> DataFrame:
        missing = F.lit(words) - F.size(code)
        zeros = F.array_repeat(F.lit(0).cast("bigint"), missing)
        return frame.where(F.col(code).isNotNull()).withColumn(code, F.concat(F.col(code), zeros))

    def segmented(frame: DataFrame, name: str) -> DataFrame:
        found = F.posexplode(F.array(*_segments(F.col(name), words, segments)))
        return frame.select(*frame.columns, found.alias("segment", "value"))

    rows, queries = filled(rows), filled(queries)
    index = settle(_distinct_codes(rows, key, code, k), "codes")
    parts = settle(segmented(index.select("code").distinct(), "code"), "segments")
    values = settle(parts.select("segment", "value").distinct(), "values")
    per_segment = values.count() / total
    pending = settle(
        queries.select(F.col(code).alias("query")).distinct().withColumn("bound", F.lit(BITS * words)),
        "pending",
    )
    best = None
    steps = [(0, 1), *[(radius, radius) for radius in range(2, width + 1)]]
    for low, high in steps:
        probes = segmented(pending, "query").withColumnRenamed("value", "own")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked = probes.select("segment", "own").distinct().repartition(tasks, "segment", "own")
        spelled = sum(comb(width, radius) for radius in range(low, high + 1))
        near = settle(
            _spelled(asked, low, high, width).join(values, ["segment", "value"], "left_semi")
            if spelled <= per_segment else _gone_through(asked, values, low, high),
            "near-values",
        )
        differing = [
            F.bit_count(one.bitwiseXOR(other)) for one, other in zip(
                _segments(F.col("query"), words, segments), _segments(F.col("code"), words, segments)
            )
        ]
        by_segment = F.array(*differing)
        first = F.array_position(by_segment, F.array_min(by_segment)) - 1
        # Each pair once: where its segments' smallest difference lies first.
        # Sizes are estimated without the explosion; the probes must not be broadcast.
        found = (
            probes.join(near, ["segment", "own"]).hint("merge").join(parts, ["segment", "value"])
            .where(F.col("segment") == first)
            .withColumn("distance", _distance(F.col("query"), F.col("code")))
            .where(F.col("distance") <= F.col("bound")).select("query", "code", "distance")
        )
        ids = found.join(index, "code").select("query", "id", "distance")
        if best is not None:
            ids = ids.unionByName(best)
        place = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
        earlier, before = best, pending
        best = settle(
            ids.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query", "id", "distance"),
            "best",
        )
        covered = total * (high + 1) - 1
        worst = best.groupBy("query").agg(
            F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n")
        )
        pending = settle(
            pending.select("query").join(worst, "query", "left")
            .withColumn("bound", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(BITS * words)))
            .where(F.col("bound") > covered).select("query", "bound"),
            "pending",
        )
        discard(before, near, *([earlier] if earlier is not None else []))
        if pending.isEmpty():
            break
    discard(index, parts, values, pending)
    place = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    ranked = best.withColumn("rank", place)
    named = queries.select(F.col(key).alias("query_id"), F.col(code).alias("query"))
    return named.join(ranked, "query").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias(key),
        F.col("distance").cast("bigint").alias("distance"),
    )
