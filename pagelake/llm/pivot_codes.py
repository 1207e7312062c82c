"""Product codes of vectors, assigned exactly with the help of pivots (LAESA).

Components become whole numbers, vectors are cut into ``parts`` consecutive parts, and each
part position has a codebook of ``entries`` parts, improved in rounds: every part goes to
its nearest entry, and every entry becomes the mean of its parts.

The distances of all parts to a few fixed *pivots* (parts of the first codebook, far from
each other) are computed once and kept with the vectors. In each round the distances from
pivots to entries are computed anew, which takes entries times pivots steps. By the triangle
inequality |d(part, pivot) - d(pivot, entry)| is at most d(part, entry). So each part looks
at the entries in the order of their largest lower bound, evaluates the exact whole-number
distance, and stops at the first bound above the best distance found. Bounds are lowered by
more than their rounding errors, so that no entry is passed over wrongly.

What a round brings to the driver are sums and counts per codebook component, as many as
the codebooks have numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.tables import discard, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed pivots of each part position.
PIVOTS = 4
#: Vectors that are assigned at once.
CHUNK = 2048
#: Largest component: squared distances of vectors with many of them still fit in a long.
LARGEST = 1 << 27
#: A label is hot if it has more than this share of the rows; so there are at most as many.
HOT_SHARE = 1000

CODE = T.StructType([
    T.StructField("code", T.StringType(), False), T.StructField("error", T.LongType(), False),
])
Codebooks = list[np.ndarray]


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.greatest(
        F.lit(-LARGEST).cast("bigint"),
        F.least(F.lit(LARGEST).cast("bigint"), F.floor(x.cast("double") * scale).cast("bigint")),
    ))


def complete(vector: Column) -> Column:
    """Whether a vector is there with all its components, and finite."""
    def finite(x):
        # Null, NaN and the infinities fail one comparison or the other.
        return F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def part_bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector lie; the first ones are longer if they can't be equal."""
    cuts = np.array_split(np.arange(size), parts)
    ends = np.cumsum([len(cut) for cut in cuts]).tolist()
    return list(zip([0] + ends[:-1], ends))


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all points to all others."""
    apart = points[:, None, :].astype(np.float64) - others[None, :, :]
    return np.sqrt((apart * apart).sum(axis=2))


def choose_pivots(codebook: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: each next one is farthest from those chosen."""
    chosen = [0]
    nearest = distances(codebook, codebook[:1])[:, 0]
    while len(chosen) < min(count, len(codebook)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(codebook, codebook[chosen[-1:]])[:, 0])
    return codebook[chosen]


def nearest_entries(
    points: np.ndarray, to_pivots: np.ndarray, codebook: np.ndarray, pivot_entry: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each point, its squared distance, and how many were evaluated.

    Of equally near entries the lower index counts.
    """
    bounds = np.zeros((len(points), len(codebook)))
    for pivot in range(to_pivots.shape[1]):
        near, far = to_pivots[:, pivot, None], pivot_entry[pivot][None, :]
        np.maximum(bounds, np.abs(near - far) - 1e-9 * (near + far), out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    ordered = np.take_along_axis(bounds, order, axis=1) ** 2
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.zeros(len(points), np.int64)
    active, evaluated = np.arange(len(points)), 0
    for step in range(len(codebook)):
        active = active[ordered[active, step] <= best[active]]
        if not len(active):
            break
        asked = order[active, step]
        apart = points[active] - codebook[asked]
        found = (apart * apart).sum(axis=1)
        evaluated += len(active)
        better = (found < best[active]) | ((found == best[active]) & (asked < entry[active]))
        best[active[better]], entry[active[better]] = found[better], asked[better]
    return entry, best, evaluated


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


class _Assigner:
    """Assigns vectors of one size; goes to the tasks with codebooks and pivot distances."""

    def __init__(self, size: int, bounds, pivots: Codebooks, codebooks: Codebooks):
        self.size, self.bounds, self.codebooks = size, bounds, codebooks
        self.pivot_entry = [distances(p, c) for p, c in zip(pivots, codebooks)]
        ends = np.cumsum([len(p) for p in pivots]).tolist()
        self.places = list(zip([0] + ends[:-1], ends))

    def chunks(self, ints: pa.Array, pivots: pa.Array) -> Iterator[tuple]:
        """(points, entries, squared distances) of all parts, a chunk of vectors at a time."""
        width = self.places[-1][1]
        for at in range(0, len(ints), CHUNK):
            points = _matrix(ints[at:at + CHUNK], self.size)
            near = _matrix(pivots[at:at + CHUNK], width)
            found = [
                nearest_entries(points[:, a:b], near[:, c:d], codebook, pivot_entry)[:2]
                for (a, b), (c, d), codebook, pivot_entry in zip(
                    self.bounds, self.places, self.codebooks, self.pivot_entry
                )
            ]
            yield points, [entry for entry, _ in found], [error for _, error in found]


def _pivot_distances(ints: Column, size: int, bounds, pivots: Codebooks) -> Column:
    """The distances of each part of a vector to the pivots of its position."""

    @F.arrow_udf(T.ArrayType(T.DoubleType(), False))
    def to_pivots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width = sum(len(p) for p in pivots)
        for batch in batches:
            points = _matrix(batch, size)
            found = np.concatenate(
                [distances(points[:, a:b], p) for (a, b), p in zip(bounds, pivots)], axis=1
            )
            yield pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width),
                pa.array(found.ravel()),
                type=pa.list_(pa.field("element", pa.float64(), False)),
            )

    return to_pivots(ints)


SUMS = "part int, entry int, pos int, total bigint, n bigint"


def _improved(vectors: DataFrame, assigner: _Assigner) -> Codebooks:
    """The codebooks after one round: floors of the means; unused entries stay."""
    codebooks = assigner.codebooks

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(c.shape, np.int64) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for points, entries, _ in assigner.chunks(batch.column("ints"), batch.column("pivots")):
                for part, (a, b) in enumerate(assigner.bounds):
                    np.add.at(totals[part], entries[part], points[:, a:b])
                    counts[part] += np.bincount(entries[part], minlength=len(counts[part]))
        rows = [
            (part, entry, pos, int(totals[part][entry, pos]), int(counts[part][entry]))
            for part in range(len(totals)) for entry in np.flatnonzero(counts[part]).tolist()
            for pos in range(totals[part].shape[1])
        ]
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "pos", "total", "n"]
        )

    means = (
        vectors.select("ints", "pivots").mapInArrow(sums, SUMS).groupBy("part", "entry", "pos")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    improved = [codebook.copy() for codebook in codebooks]
    for row in means.collect():  # one row per number of the codebooks
        improved[row.part][row.entry, row.pos] = row.total // row.n
    return improved


def _codes(vectors: DataFrame, assigner: _Assigner) -> DataFrame:
    @F.arrow_udf(CODE)
    def code(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ints, pivots in batches:
            codes, errors = [], [np.zeros(0, np.int64)]
            for _, entries, squared in assigner.chunks(ints, pivots):
                table = np.stack(entries, axis=1).astype(np.uint8)
                codes += [row.tobytes().hex() for row in table]
                errors.append(np.sum(squared, axis=0))
            yield pa.StructArray.from_arrays(
                [pa.array(codes, pa.string()), pa.array(np.concatenate(errors))],
                fields=[pa.field("code", pa.string(), False), pa.field("error", pa.int64(), False)],
            )

    return vectors.select("id", "label", code("ints", "pivots").alias("c")).select(
        "id", "label", "c.*"
    )


def codebooks_digest(codebooks: Codebooks) -> str:
    """SHA-256 of all numbers by part, entry and position, joined by commas."""
    numbers = ",".join(str(x) for codebook in codebooks for x in codebook.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def encode(
    vectors: DataFrame, size: int, parts: int, entries: int, rounds: int
) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error) of vectors (id, label, ints) of one size; the codebooks."""
    bounds = part_bounds(size, parts)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    start = np.array([row.ints for row in first], np.int64).reshape(len(first), size)
    codebooks = [start[:, a:b] for a, b in bounds]
    pivots = [choose_pivots(codebook, PIVOTS) for codebook in codebooks]
    near = settle(
        vectors.withColumn("pivots", _pivot_distances(F.col("ints"), size, bounds, pivots)),
        "pivots",
    )
    for _ in range(rounds):
        codebooks = _improved(near, _Assigner(size, bounds, pivots, codebooks))
    coded = settle(_codes(near, _Assigner(size, bounds, pivots, codebooks)), "codes")
    discard(near)
    return coded, codebooks


def _with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over equal labels, nulls together.

    The few labels that have many rows each are broadcast, others joined by label.
    """
    sums = settle(
        coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
        .withColumnRenamed("label", "of"),
        "labels",
    )
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    same = F.col("label").eqNullSafe(F.col("of"))
    # Fewer than HOT_SHARE labels can each have more than that share of all rows.
    many = F.broadcast(sums.where(hot))
    often = coded.join(many, same).drop("of", "n")
    seldom = coded.join(many, same, "left_anti").join(sums.where(~hot), same).drop("of", "n")
    return often.unionByName(seldom)


def pivot_codes(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> DataFrame:
    """(key, code, error, label, label_error, codebooks_sha256) of the complete vectors.

    Rows whose vector is null, or holds a null or a component that is not finite, are left
    out. Codebooks start as the parts of the rows with the smallest keys (missing keys come
    last, ties are broken by the vector); with fewer than ``entries`` rows they have fewer
    entries. Repeated rows count as often as they occur. Vectors of different sizes have
    codebooks of their own, as have empty ones, whose error is 0; parts differ by one
    component if the size is no multiple of ``parts``. Components beyond 2**27 after scaling
    count as that, so that errors fit in a long. No rows give no rows.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits")
    kept = settle(
        rows.where(complete(F.col(vector))).select(
            F.col(key).alias("id"), F.col(label).alias("label"),
            whole_numbers(F.col(vector), scale).alias("ints"),
        ),
        "vectors",
    )
    sizes = [row[0] for row in kept.select(F.size("ints")).distinct().collect()]
    parts_of = []
    for size in sorted(sizes):
        coded, codebooks = encode(
            kept.where(F.size("ints") == size), size, parts, entries, rounds
        )
        parts_of.append(coded.withColumn("digest", F.lit(codebooks_digest(codebooks))))
    if parts_of:
        coded = parts_of[0]
        for more in parts_of[1:]:
            coded = coded.unionByName(more)
    else:
        coded = kept.select(
            "id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
            F.lit("").alias("digest"),
        )
    result = _with_label_error(coded)
    return result.select(
        F.col("id").alias(key), "code", "error", F.col("label").alias(label),
        F.col("label_error").cast("bigint").alias("label_error"),
        F.col("digest").alias("codebooks_sha256"),
    )
