"""Packing of documents into token sequences by vector best fit.

Documents become pieces of at most ``tokens`` tokens. A sequence has three capacities:
tokens, documents and attention cost (the sum of the pieces' squared lengths). What a piece
takes of each depends on its length alone, so a histogram of lengths, one row per length
and so at most ``tokens`` rows for any corpus, is all the packing has to see. It works on
classes: all pieces of a length, from long to short, and all open sequences with the same
residual capacities. For each class it picks, among the sequences where every constraint
holds, those whose residual after placing is smallest by weighted norm (or whose residual
has the largest weighted dot product with the piece), and fills as many as the class has
pieces for. The plan is a short table of intervals: pieces ``rank`` to ``rank + n`` of a
length go to sequences from ``sequence`` on.

Pieces are numbered within their length without bringing a length into one task: by a hash
of the piece into ``CHUNKS`` parts, with the parts' sizes added up first.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.tables import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Id that ends each document.
END_ID = 0
#: Parts into which the pieces of one length are dealt for numbering.
CHUNKS = 1024

#: Words whose ids a worker remembers, and the longest of them: some 40 MB.
_REMEMBERED = 200_000
_LONGEST_REMEMBERED = 64
#: White space around a blank, where cutting before the blank would change the pieces.
_ODD = re.compile(r"\s \s|\s $")
_LONG_WORD = 1000

PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType(), False),
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False),
    T.StructField("ids", T.ArrayType(T.LongType(), False), True),
]), False)


class _Words(dict):
    """Ids, as bytes, of a blank and the word after it."""

    def __init__(self, tokenizer, ranks):
        super().__init__()
        self.tokenizer, self.ranks = tokenizer, ranks

    def __missing__(self, word):
        ids = self.encode(" " + word)
        if len(self) < _REMEMBERED and len(word) <= _LONGEST_REMEMBERED:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.ranks is None or len(text) > _LONG_WORD:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@functools.cache
def _load(path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ranks = None
    if ranks_path is not None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        ranks = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
    special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, _Words(tokenizer, ranks), special


def token_bytes(path: str, ranks_path: str | None, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers.

    Words are looked up one by one: the splitting pattern starts afresh at every blank that
    has a letter, digit or sign on at least one side. Other texts, and those that contain a
    special token, are encoded as a whole.
    """
    tokenizer, words, special = _load(path, ranks_path)
    if any(token in text for token in special) or (_ODD.search(text)):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    first, *rest = text.split(" ")
    return words.encode(first) + b"".join(map(words.__getitem__, rest))


def cut_lengths(size: int, tokens: int) -> list[int]:
    """A document of ``size`` tokens in pieces: a shorter one first, then full ones."""
    if size <= tokens:
        return [size]
    head = [size % tokens] if size % tokens else []
    return head + [tokens] * (size // tokens)


def _pieces(
    text: Column, path: str, ranks_path: str | None, tokens: int, with_ids: bool
) -> Column:
    names = ("piece", "start", "length", "ids_crc32")
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    element = pa.struct(
        [pa.field(name, kind, False) for name, kind in zip(names, types)]
        + [pa.field("ids", pa.list_(pa.field("element", pa.int64(), False)))]
    )
    end = END_ID.to_bytes(4, "little")

    def rows(one: str | None) -> list[tuple]:
        ids = token_bytes(path, ranks_path, one or "") + end
        out, start = [], 0
        for number, length in enumerate(cut_lengths(len(ids) // 4, tokens)):
            part = ids[4 * start:4 * (start + length)]
            kept = np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None
            out.append((number, start, length, zlib.crc32(part), kept))
            start += length
        return out

    @F.arrow_udf(PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [rows(one) for one in batch.to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            columns = list(zip(*[row for x in found for row in x])) or [()] * 5
            arrays = [pa.array(c, f.type) for c, f in zip(columns, element)]
            yield pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=list(element)),
                type=pa.list_(pa.field("element", element, False)),
            )

    return pieces(text)


def token_pieces(
    docs: DataFrame, path: str, tokens: int, *, ranks_path: str | None = None,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key, piece, start, length, ids_crc32 and, if asked, ids.

    Each document is its ids and ``END_ID``; a null text is an empty one. ``ranks_path`` may
    name the same vocabulary as ranks, which encodes single words faster.
    """
    fields = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    cut = F.explode(_pieces(F.col(text), path, ranks_path, tokens, with_ids)).alias("p")
    return docs.select(F.col(key), cut).select(key, *[f"p.{name}" for name in fields])


@dataclass
class Capacities:
    """Limits of one sequence and the weights of its residuals."""

    tokens: int
    documents: int
    cost: int
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


@dataclass
class _Open:
    """Sequences with the same residual: as intervals (first, number)."""

    bins: list[tuple[int, int]] = field(default_factory=list)

    def take(self, count: int) -> list[tuple[int, int]]:
        taken = []
        while count:
            first, number = self.bins.pop()
            used = min(count, number)
            taken.append((first, used))
            if used < number:
                self.bins.append((first + used, number - used))
            count -= used
        return taken

    def size(self) -> int:
        return sum(number for _, number in self.bins)


def plan_packing(histogram: dict[int, int], limits: Capacities) -> list[tuple]:
    """(length, rank, n, sequence, offset, per_sequence) rows that place every piece.

    Pieces ``rank .. rank + n`` of the length fill sequences from ``sequence`` on,
    ``per_sequence`` in each, one after the other from ``offset``.
    """
    caps = np.array([limits.tokens, limits.documents, limits.cost], np.float64)
    weights = np.array(limits.weights) / caps**2
    full = (limits.tokens, limits.documents, limits.cost)
    states: dict[tuple, _Open] = {}
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left, rank = histogram[length], 0
        while left:
            residuals = np.array(list(states), np.int64).reshape(-1, 3)
            fits = np.flatnonzero((residuals >= demand).all(axis=1))
            if len(fits):
                if limits.rule == "dot":
                    score = -(residuals[fits] * demand) @ weights
                else:
                    score = ((residuals[fits] - demand) ** 2.0) @ weights
                state = tuple(residuals[fits[np.argmin(score)]].tolist())
            else:
                state = full
                room = min(r // d for r, d in zip(full, demand.tolist()))
                number = -(-left // room)
                states.setdefault(full, _Open()).bins.append((opened, number))
                opened += number
            # By norm a sequence that took a piece is the best for the next one as well.
            room = min(r // d for r, d in zip(state, demand.tolist()))
            room = 1 if limits.rule == "dot" else min(room, left)
            here = states[state]
            for first, number in here.take(min(here.size(), left // room)):
                used = limits.tokens - state[0]
                plan.append((length, rank, number * room, first, used, room))
                rank, left = rank + number * room, left - number * room
                after = tuple(r - room * d for r, d in zip(state, demand.tolist()))
                states.setdefault(after, _Open()).bins.append((first, number))
            if not here.bins:
                del states[state]
    return plan


PLAN = "length bigint, rank bigint, n bigint, sequence bigint, place bigint, per_sequence bigint"


def numbered(pieces: DataFrame, key: str) -> DataFrame:
    """``pieces`` with ``rank`` from 0 within their length."""
    chunk = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(CHUNKS))
    dealt = pieces.withColumn("chunk", chunk)
    sizes = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("size"))
    # At most CHUNKS rows per length.
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "length", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")
    )
    inside = W.partitionBy("length", "chunk").orderBy(key, "piece", "ids_crc32")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(starts, ["length", "chunk"])
        .withColumn("rank", F.col("inside") + F.col("before"))
        .drop("inside", "before", "chunk")
    )


def pack(pieces: DataFrame, limits: Capacities, *, key: str = "doc_id") -> DataFrame:
    """``pieces`` (key, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of a sequence lie one after the other from offset 0 without gaps. Every
    capacity holds in every sequence. Repeated rows are pieces of their own; null keys are
    keys like any other. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # one row per length
    rows = plan_packing({row["length"]: row["count"] for row in counts}, limits)
    plan = spark.createDataFrame(rows, PLAN)
    place = F.col("r.rank") - F.col("p.rank")
    return (
        numbered(pieces, key).alias("r")
        # The plan's size depends on the number of lengths, not of pieces.
        .join(
            F.broadcast(plan).alias("p"),
            (F.col("r.length") == F.col("p.length"))
            & (F.col("r.rank") >= F.col("p.rank"))
            & (F.col("r.rank") < F.col("p.rank") + F.col("p.n")),
        )
        .select(
            *[f"r.{name}" for name in (key, "piece", "start", "length", "ids_crc32")],
            (F.col("p.sequence") + F.floor(place / F.col("p.per_sequence"))).cast("bigint")
            .alias("sequence_id"),
            (F.col("p.place") + (place % F.col("p.per_sequence")) * F.col("r.length"))
            .cast("bigint").alias("offset"),
        )
    )


def pack_documents(
    docs: DataFrame, path: str, tokens: int, *, ranks_path: str | None = None,
    max_documents: int | None = None, max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm",
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece, see :func:`pack`.

    Without ``max_documents`` and ``max_cost`` only the tokens limit a sequence. Texts are
    tokenized once: the pieces, without their ids, are written to the shared folder. Null
    and empty texts are one piece of one token.
    """
    limits = Capacities(
        tokens, max_documents or tokens, max_cost or tokens * tokens, weights, rule
    )
    pieces = token_pieces(docs, path, tokens, ranks_path=ranks_path, key=key, text=text)
    return pack(settle(pieces, "pieces"), limits, key=key)
