"""Removal of repeated passages by compaction of a De Bruijn graph of words.

A window is ``window`` consecutive words. Windows are the edges of the graph, from their
first to their last ``window - 1`` words; the edges of interest are the repeated ones.

1. *Anchors.* Every window has an anchor: of the runs of ``ANCHOR`` words in it, the first
   one of smallest hash. A repeated window's anchor is found twice, too, so only windows
   with a repeated anchor are looked at further; about one anchor comes for seven words.
2. *Edges.* Those windows are counted by hash, with the first place (document, position)
   they start at, and the window before if it is the same wherever they occur.
3. *Compaction.* An edge continues its predecessor if neither branches: the predecessor
   comes before it everywhere, and occurs no more often, so that it is followed by it
   everywhere. That is a join of edges with edges. As the occurrences of both then
   correspond one to one, a nonbranching path lies in one piece where its first edge was
   first found, and is read off there by position.
4. *Verification.* The source coordinates of each path give its words. Their digest goes
   with the path to all other places where its first edge occurs, and words are removed
   only where they have that digest.

Rows whose words are an exact copy of an earlier document are settled beforehand by a hash
of all their words: each of their windows starts earlier there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.tables import WHITE, discard, free_name, settle
from pagelake.operators.ordering import number_all

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 20
ANCHOR = 8

_BATCH_BYTES = 500_000
#: Powers that a worker keeps; longer texts have theirs computed and let go.
_KEPT_POWERS = 1 << 20
#: Odd multipliers of the polynomial hashes of bytes in a word and of words in a run.
_BYTE_STEP = 0x9E3779B97F4A7C15
_WORD_STEP = 0xD1342543DE82EF95

_powers: dict[int, np.ndarray] = {}

WINDOWS = T.ArrayType(T.StructType([
    T.StructField(name, kind, False) for name, kind in (
        ("h", T.LongType()), ("pos", T.IntegerType()), ("prev", T.LongType()),
    )
]), False)
ANCHORS = T.ArrayType(T.StructType([
    T.StructField("a", T.LongType(), False), T.StructField("pos", T.IntegerType(), False),
]), False)
SEQUENCE = T.StructType([
    T.StructField("n", T.LongType(), False), T.StructField("s1", T.LongType(), False),
    T.StructField("s2", T.LongType(), False),
])
REPEATS = T.StructType([
    T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False),
    T.StructField("kept", T.StringType(), False),
])


def _power(step: int, size: int) -> np.ndarray:
    """step**0, step**1, ... modulo 2**64, at least ``size`` of them."""
    known = _powers.get(step)
    if known is None or len(known) < size:
        factors = np.full(max(size, 1 << 16), step, np.uint64)
        factors[0] = 1
        known = np.cumprod(factors)
        if size <= _KEPT_POWERS:
            _powers[step] = known
    return known


def _mix(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of the values over all 64."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Hash of values[start:end] for each pair, from differences of one running sum."""
    powers = _power(step, len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:len(values)])))
    backwards = _power(pow(step, -1, 1 << 64), len(values) + 1)
    return _mix((sums[ends] - sums[starts]) * backwards[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a few texts: their bytes, and a hash of each."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.joined, np.uint8)
        inside = ~np.isin(data, np.frombuffer(WHITE.encode(), np.uint8))
        edges = np.diff(np.concatenate(([False], inside)).astype(np.int8))
        self.starts = np.flatnonzero(edges == 1)
        self.ends = np.flatnonzero(edges == -1)
        text_ends = np.cumsum([len(text) + 1 for text in texts])
        # Words first[t] .. first[t + 1] belong to text t.
        self.first = np.concatenate(([0], np.searchsorted(self.starts, text_ends)))
        self.hashes = _runs(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTE_STEP)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and which of them lie within one text."""
        count = max(0, len(self.hashes) - size + 1)
        starts = np.arange(count)
        found = _runs(self.hashes, starts, starts + size, _WORD_STEP)
        end_of = np.repeat(self.first[1:], np.diff(self.first))
        return found, starts + size <= end_of[:count]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window start: whether it is valid and where its anchor is; all anchor hashes."""
        size = min(ANCHOR, window)
        hashes, _ = self.windows(size)
        count = max(0, len(self.hashes) - window + 1)
        if not count:
            return np.zeros(0, bool), np.zeros(0, np.int64), hashes
        end_of = np.repeat(self.first[1:], np.diff(self.first))
        starts = np.arange(count)
        valid = starts + window <= end_of[:count]
        view = np.lib.stride_tricks.sliding_window_view(hashes, window - size + 1)[:count]
        return valid, starts + np.argmin(view, axis=1), hashes

    def digest(self, start: int, end: int) -> bytes:
        """Digest of words start .. end, whatever white space lies between them."""
        words = self.joined[self.starts[start]:self.ends[end - 1]].split()
        return blake2b(b" ".join(words), digest_size=16).digest()


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, a few at a time, with the place of the first."""
    group, held, at = [], 0, 0
    for number, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and held + len(data) > _BATCH_BYTES:
            yield at, group
            group, held, at = [], 0, number
        group.append(data)
        held += len(data)
    if group:
        yield at, group


def _lists(counts: list[int], columns: list[tuple[str, np.ndarray]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    arrays = [pa.array(values) for _, values in columns]
    fields = [pa.field(name, a.type, False) for (name, _), a in zip(columns, arrays)]
    structs = pa.StructArray.from_arrays(arrays, fields=fields)
    return pa.ListArray.from_arrays(
        pa.array(offsets), structs, type=pa.list_(pa.field("element", structs.type, False))
    )


def _sequences(text: Column) -> Column:
    """The number of words and 128 bits of hash of all of them in order."""

    @F.arrow_udf(SEQUENCE)
    def sequences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros((len(batch), 3), np.int64)
            for at, group in _groups(batch.to_pylist()):
                for number, data in enumerate(group):
                    words = data.split()
                    digest = blake2b(b" ".join(words), digest_size=16).digest()
                    out[at + number] = (len(words), *np.frombuffer(digest, np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(column) for column in out.T.copy()],
                fields=[pa.field(name, pa.int64(), False) for name in ("n", "s1", "s2")],
            )

    return sequences(text)


def _anchors(text: Column, window: int) -> Column:
    """The distinct anchors of a text's windows: hash and word position."""

    @F.arrow_udf(ANCHORS)
    def anchors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, hashes, places = [], [], []
            for _, group in _groups(batch.to_pylist()):
                words = Words(group)
                valid, at, values = words.anchors(window)
                at = np.unique(at[valid])
                text_of = np.searchsorted(words.first, at, side="right") - 1
                counts.extend(np.bincount(text_of, minlength=len(group)).tolist())
                hashes.append(values[at].view(np.int64))
                places.append((at - words.first[text_of]).astype(np.int32))
            yield _lists(counts, [
                ("a", np.concatenate(hashes or [np.zeros(0, np.int64)])),
                ("pos", np.concatenate(places or [np.zeros(0, np.int32)])),
            ])

    return anchors(text)


def _windows(text: Column, places: Column, window: int) -> Column:
    """Windows of a text whose anchor is at one of ``places``, with the one before each."""

    @F.arrow_udf(WINDOWS)
    def windows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, allowed in batches:
            counts, columns = [], [[], [], []]
            for at, group in _groups(texts.to_pylist()):
                words = Words(group)
                valid, anchor, _ = words.anchors(window)
                wanted = np.zeros(len(words.hashes) + 1, bool)
                for number in range(len(group)):
                    own = allowed[at + number].values.to_numpy(zero_copy_only=False)
                    size = words.first[number + 1] - words.first[number]
                    wanted[words.first[number] + own[own < size]] = True
                hashes, _ = words.windows(window)
                # 0 stands for no, or no repeated, window before.
                hashes = np.where(hashes == 0, np.uint64(1), hashes)
                chosen = valid & wanted[anchor]
                # Not by way of floats: mixed whole numbers would lose their last bits.
                known = np.zeros(len(hashes) + 1, np.uint64)
                known[1:][chosen] = hashes[chosen]
                found = np.flatnonzero(chosen)
                text_of = np.searchsorted(words.first, found, side="right") - 1
                # A neighbour in another text is none: the windows between are not valid.
                before = np.where(found > words.first[text_of], known[found], np.uint64(0))
                counts.extend(np.bincount(text_of, minlength=len(group)).tolist())
                for column, values in zip(columns, (
                    hashes[found].view(np.int64),
                    (found - words.first[text_of]).astype(np.int32),
                    before.view(np.int64),
                )):
                    column.append(values)
            kinds = (np.int64, np.int32, np.int64)
            yield _lists(counts, [
                (name, np.concatenate(column or [np.zeros(0, kind)]))
                for name, column, kind in zip(("h", "pos", "prev"), columns, kinds)
            ])

    return windows(text, places)


def _span_digests(text: Column, spans: Column) -> Column:
    """The digest of each span (pos, size) of a text; empty where it has no such words."""

    @F.arrow_udf(T.ArrayType(T.BinaryType(), False))
    def digests(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, asked in batches:
            out = []
            for text, wanted in zip(texts, asked):
                words = Words([(text.as_py() or "").encode("utf-8", "surrogatepass")])
                count = len(words.hashes)
                out.append([
                    words.digest(span["pos"], span["pos"] + span["size"])
                    if span["pos"] + span["size"] <= count else b""
                    for span in wanted.as_py()
                ])
            yield pa.array(out, pa.list_(pa.field("element", pa.binary(), False)))

    return digests(text, spans)


def _removed(text: Column, spans: Column, copied: Column) -> Column:
    """Words left when the verified spans (pos, size, digest), or all words, are removed."""

    @F.arrow_udf(REPEATS)
    def removed(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]
    ) -> Iterator[pa.Array]:
        for texts, found, copies in batches:
            rows = []
            for text, spans_of, copy in zip(texts, found, copies):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = data.split()
                gone = np.full(len(words), bool(copy.as_py()))
                for span in spans_of.as_py() or ():
                    start, end = span["pos"], span["pos"] + span["size"]
                    part = b" ".join(words[start:end])
                    if blake2b(part, digest_size=16).digest() == span["digest"]:
                        gone[start:end] = True
                if gone.any():
                    stay = [words[at] for at in np.flatnonzero(~gone)]
                else:
                    stay = words
                kept = b" ".join(stay).decode("utf-8", "surrogatepass")
                rows.append((len(words), int(gone.sum()), kept))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string())],
                fields=[pa.field("n_words", pa.int64(), False),
                        pa.field("n_removed", pa.int64(), False),
                        pa.field("kept", pa.string(), False)],
            )

    return removed(text, spans, copied)


#: What tells documents apart: the key, and 128 bits of hash of the text. The one number
#: ``id`` made of them goes with the anchors; rows are joined by all three.
IDENTITY = ["key", "t1", "t2"]


def identified(key: Column, text: Column) -> list[Column]:
    """The columns IDENTITY of a row; a null key comes before all others."""
    return [
        F.coalesce(key.cast("bigint"), F.lit(-(1 << 63))).alias("key"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"),
    ]


class Places:
    """Numbers for documents in the order of their keys, and for the places in them.

    A place is one whole number, document and position, that orders like both: counting
    windows then works on numbers alone. Different texts with one key are documents of
    their own, in the order of their hashes.
    """

    def __init__(self, sequences: DataFrame):
        documents = sequences.select(*IDENTITY).distinct()
        numbered = number_all(documents, [F.col(name) for name in IDENTITY], "doc")
        self.docs = settle(numbered.withColumn("id", F.xxhash64(*IDENTITY)), "documents")
        most = sequences.agg(F.max("n")).first()[0] or 1
        self.bits = int(most).bit_length()
        documents = self.docs.agg(F.max("doc")).first()[0] or 1
        if int(documents).bit_length() + self.bits > 63:
            raise ValueError("document numbers and positions exceed 63 bits")

    def of(self, doc: Column, pos: Column) -> Column:
        return F.shiftleft(doc, self.bits).bitwiseOR(pos.cast("bigint"))

    def doc(self, place: Column) -> Column:
        return F.shiftright(place, self.bits)

    def pos(self, place: Column) -> Column:
        return place.bitwiseAND(F.lit((1 << self.bits) - 1).cast("bigint")).cast("int")


def exact_copies(sequences: DataFrame) -> DataFrame:
    """Identities of rows (s1, s2) whose words an earlier document has, too."""
    own = F.struct(*IDENTITY)
    groups = settle(
        sequences.groupBy("s1", "s2").agg(F.min(own).alias("source"), F.max(own).alias("last"))
        .where("source < last").select("s1", "s2", "source"),
        "copies",
    )
    copies = settle(
        sequences.join(groups, ["s1", "s2"]).where(own > F.col("source"))
        .select(*IDENTITY).distinct(),
        "copies",
    )
    discard(groups)
    return copies


def candidate_windows(
    docs: DataFrame, copies: DataFrame, places: Places, window: int
) -> DataFrame:
    """(h, place, prev) of the windows whose anchor is found more than once."""
    anchors = settle(
        docs.select(
            F.xxhash64(*IDENTITY).alias("id"), F.explode(_anchors(F.col("text"), window)).alias("x")
        ).select("id", "x.a", "x.pos"),
        "anchors",
    )
    repeated = settle(
        anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"),
        "anchors",
    )
    # Should two documents share an id, each gets the other's anchors as well: more
    # windows are looked at, none is lost.
    chosen = settle(
        anchors.join(repeated, "a").groupBy("id").agg(F.collect_set("pos").alias("places"))
        .join(places.docs, "id").drop("id").join(copies, IDENTITY, "left_anti"),
        "places",
    )
    discard(anchors, repeated)
    found = docs.join(chosen, IDENTITY).select(
        "doc", F.explode(_windows(F.col("text"), F.col("places"), window)).alias("x")
    )
    windows = settle(
        found.select(
            "x.h", places.of(F.col("doc"), F.col("x.pos")).alias("place"), "x.prev"
        ),
        "windows",
    )
    discard(chosen)
    return windows


def repeated_edges(windows: DataFrame) -> DataFrame:
    """(h, place, prev, n): repeated windows, where they start first, the only window found
    before them (0 if there are several or none), and how often they occur."""
    only = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(0))
    return settle(
        windows.groupBy("h").agg(
            F.min("place").alias("place"), F.count(F.lit(1)).alias("n"),
            F.min("prev").alias("low"), F.max("prev").alias("high"),
        ).where("n > 1").select("h", "place", only.alias("prev"), "n"),
        "edges",
    )


def paths(edges: DataFrame, places: Places, window: int) -> DataFrame:
    """(h, place, size): nonbranching paths by their first edge, their source, and words."""
    e, p = edges.alias("e"), edges.select("h", "n").alias("p")
    # Edges without an only predecessor look for themselves and do not match.
    wanted = F.when(F.col("e.prev") == 0, F.col("e.h")).otherwise(F.col("e.prev"))
    marked = e.join(
        p,
        (wanted == F.col("p.h")) & (F.col("e.prev") != 0) & (F.col("p.n") == F.col("e.n")),
        "left",
    ).select(
        "e.h", "e.place", places.doc(F.col("e.place")).alias("doc"),
        F.col("p.h").isNull().cast("int").alias("head"),
    )
    along = W.partitionBy("doc").orderBy("place")
    numbered = marked.withColumn("path", F.sum("head").over(along))
    return settle(
        numbered.groupBy("doc", "path")
        .agg(F.max(F.when(F.col("head") == 1, F.col("h"))).alias("h"),
             F.min("place").alias("place"),
             (F.count(F.lit(1)) + window - 1).cast("int").alias("size"))
        .select("h", "place", "size"),
        "paths",
    )


def repeated_spans(
    docs: DataFrame, copies: DataFrame, places: Places, window: int
) -> DataFrame:
    """IDENTITY and spans: where paths occur other than at their source; spans are structs
    of pos, size and the digest of the source's words."""
    windows = candidate_windows(docs, copies, places, window)
    edges = repeated_edges(windows)
    found = paths(edges, places, window)
    discard(edges)
    asked = settle(
        found.groupBy(places.doc(F.col("place")).alias("doc"))
        .agg(F.collect_list(
            F.struct("h", places.pos(F.col("place")).alias("pos"), "size")
        ).alias("asked"))
        .join(places.docs, "doc").select(*IDENTITY, "asked"),
        "asked",
    )
    digests = settle(
        docs.join(asked, IDENTITY).select(
            F.explode(F.arrays_zip(
                "asked",
                _span_digests(F.col("text"), F.transform(
                    "asked", lambda x: F.struct(x["pos"].alias("pos"), x["size"].alias("size"))
                )).alias("digest"),
            )).alias("x")
        ).select("x.asked.h", "x.digest").where("digest != X''").distinct(),
        "digests",
    )
    sourced = settle(
        found.withColumnRenamed("place", "source").join(digests, "h"), "sourced"
    )
    discard(found, asked, digests)
    spans = settle(
        windows.select("h", "place").join(sourced, "h").where("place != source")
        .groupBy(places.doc(F.col("place")).alias("doc"))
        .agg(F.collect_set(
            F.struct(places.pos(F.col("place")).alias("pos"), "size", "digest")
        ).alias("spans"))
        .join(places.docs, "doc").select(*IDENTITY, "spans"),
        "spans",
    )
    discard(windows, sourced)
    return spans


def remove_repeats(
    docs: DataFrame, *, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a struct column ``repeats`` (underscores if taken).

    Fields: ``n_words``, ``n_removed`` and ``kept``, the remaining words joined by blanks. A
    word is removed if a window of ``window`` words covers it whose words also start
    earlier: at a smaller key, or further left at the same key. Windows are judged on the
    texts as given.

    Null, empty and blank texts have no words. Keys are whole numbers; a null key comes
    before all others. Repeated rows are the same place and do not remove each other's
    words. Different texts with one key, or none, are documents of their own, in the order
    of a hash of their texts. An empty table gives an empty table.
    """
    rows = docs.select(*identified(F.col(key), F.col(text)), F.col(text).alias("text"))
    sequences = settle(
        rows.select(*IDENTITY, _sequences(F.col("text")).alias("s")).select(*IDENTITY, "s.*")
        .where(F.col("n") >= window),
        "sequences",
    )
    copies = exact_copies(sequences)
    places = Places(sequences)
    spans = repeated_spans(rows, copies, places, window)
    discard(sequences, places.docs)
    gone = settle(copies.withColumn("copied", F.lit(True)).join(spans, IDENTITY, "full"), "gone")
    discard(copies, spans)
    result = free_name(docs, "repeats")
    found = gone.select(
        *[F.col(name).alias(f"of_{name}") for name in IDENTITY], F.col("spans").alias("of_spans"),
        F.col("copied").alias("of_copied"),
    ).select(F.struct("*").alias("g"))
    d = docs.select(
        F.struct("*").alias("d"),
        F.struct(*identified(F.col(key), F.col(text))).alias("i"),
    )
    same = [F.col(f"i.{name}") == F.col(f"g.of_{name}") for name in IDENTITY]
    return d.join(found, same, "left").select(
        "d.*",
        _removed(
            F.col("d")[text], F.col("g.of_spans"), F.coalesce(F.col("g.of_copied"), F.lit(False))
        ).alias(result),
    )
