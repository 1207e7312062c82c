"""BPE encoding and decoding with a public tokenizer, by tree concatenation.

A text is a tree of halves: it is cut at its middle, and the halves at theirs, until no
part is longer than ``LEAF_CHARS``. Most texts are a tree of one leaf. Leaves are rows, so
the parts of one long text are encoded by different tasks. Going up the tree, two
neighbours are concatenated: a window around the join is encoded again, and grows until
its tokens agree with the left side's before the join and with the right side's after it,
at a distance from the join and in the same places of the text. The result then has the
same neighbouring tokens everywhere as an encoding of the whole, which fixes a BPE
encoding. If both sides never agree, the window is the whole text, and exact as well.

Leaves that are whole texts are encoded word by word, since no merge crosses white space:
a word met before costs one dictionary lookup.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.tables import free_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Longest text that is encoded in one piece, in characters.
LEAF_CHARS = 65_536

#: First reach of a window on either side of a join.
WINDOW = 256

#: Tokens agree only so far from a join that no special token can lie across it.
MARGIN = 32

#: Words remembered by one worker.
_REMEMBERED = 400_000

#: Characters that libraries disagree on whether they are white space.
_DISPUTED = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("decoded", T.StringType(), False),
])
LEAF = T.StructType([
    T.StructField(name, T.ArrayType(T.IntegerType(), False), False)
    for name in ("ids", "starts", "ends")
])
_ARROW_INTS = pa.list_(pa.field("element", pa.int32(), False))


class _Words(dict):
    """Ids (as bytes) and decoded text of words; unknown ones are encoded when asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word):
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = (np.array(ids, "<i4").tobytes(), self.decode(ids))
        if len(self) < _REMEMBERED:
            self[word] = found
        return found

    def decode(self, ids) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@functools.cache
def _load(path: str):
    """The tokenizer, the words known so far, and whether texts go word by word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    # White space is dropped and tokens are joined by blanks: words are independent.
    apart = parts.get("decoder") is None and parts["model"].get("end_of_word_suffix") is not None
    return tokenizer, _Words(tokenizer), apart


def encode_text(path: str, text: str) -> tuple[np.ndarray, str]:
    """Ids and decoded text of a text short enough for one piece."""
    tokenizer, words, apart = _load(path)
    if not apart or _DISPUTED.search(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int32), words.decode(ids)
    found = [words[word] for word in text.split()]
    ids = b"".join([pair[0] for pair in found])
    return np.frombuffer(ids, "<i4"), " ".join([pair[1] for pair in found if pair[0]])


class Encoding:
    """Tokens of a text: ids and, for each token, its start and end in the text."""

    def __init__(self, text: str, ids, starts, ends):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends

    @classmethod
    def of(cls, tokenizer, text: str) -> Encoding:
        found = tokenizer.encode(text, add_special_tokens=False)
        places = np.array(found.offsets, np.int32).reshape(-1, 2)
        return cls(text, np.array(found.ids, np.int32), places[:, 0], places[:, 1])

    def clean(self, at: int) -> bool:
        """Whether no character belongs to tokens on both sides of token ``at``'s start."""
        return at == 0 or at >= len(self.ids) or self.starts[at] >= self.ends[at - 1]

    def same(self, at: int, other: Encoding, there: int, shift: int) -> bool:
        """Whether two tokens are equal and lie in the same place of the whole text."""
        return (
            self.ids[at] == other.ids[there]
            and self.starts[at] + shift == other.starts[there]
            and self.ends[at] + shift == other.ends[there]
        )


def _left_agreement(left: Encoding, first: int, window: Encoding, low: int, limit: int) -> int:
    """How many first tokens of the window equal the left side's and end before ``limit``."""
    agreed = 0
    while (
        agreed < len(window.ids) and first + agreed < len(left.ids)
        and window.ends[agreed] + low <= limit
        and window.same(agreed, left, first + agreed, low)
    ):
        agreed += 1
    while agreed and not (window.clean(agreed) and left.clean(first + agreed)):
        agreed -= 1
    return agreed


def _right_agreement(right: Encoding, window: Encoding, shift: int, limit: int):
    """The first place after ``limit`` where two tokens in a row equal the right side's.

    Returns the token of the window and of the right side, or None. ``shift`` leads from
    places in the window to places in the right side.
    """
    at = {
        (int(right.starts[i]), int(right.ends[i]), int(right.ids[i])): i
        for i in range(int(np.searchsorted(right.starts, limit)), len(right.ids))
        if right.starts[i] < len(window.text) + shift
    }
    for mine in range(len(window.ids) - 1):
        if window.starts[mine] + shift < limit:
            continue
        key = (int(window.starts[mine]) + shift, int(window.ends[mine]) + shift,
               int(window.ids[mine]))
        theirs = at.get(key)
        if (
            theirs is not None and theirs + 1 < len(right.ids)
            and window.same(mine + 1, right, theirs + 1, shift)
            and window.clean(mine) and right.clean(theirs)
        ):
            return mine, theirs
    return None


def concatenate(tokenizer, left: Encoding, right: Encoding) -> Encoding:
    """The encoding of both texts together, from their encodings."""
    text, join = left.text + right.text, len(left.text)
    reach = WINDOW
    while True:
        first = int(np.searchsorted(left.starts, join - reach)) if reach < join else 0
        while not left.clean(first):
            first -= 1
        low = int(left.starts[first]) if reach < join and first < len(left.ids) else 0
        if low == 0:
            first = 0
        high = min(len(text), join + reach)
        window = Encoding.of(tokenizer, text[low:high])
        if low == 0:
            agreed = 0
        else:
            agreed = _left_agreement(left, first, window, low, join - MARGIN)
        if high == len(text):
            meeting = len(window.ids), len(right.ids)
        else:
            meeting = _right_agreement(right, window, low - join, MARGIN)
        if (low == 0 or agreed >= 2) and meeting is not None and meeting[0] >= agreed:
            mine, theirs = meeting
            parts = (
                (left, slice(0, first + agreed), 0),
                (window, slice(agreed, mine), low),
                (right, slice(theirs, len(right.ids)), join),
            )
            return Encoding(
                text,
                np.concatenate([part.ids[cut] for part, cut, _ in parts]),
                np.concatenate([part.starts[cut] + move for part, cut, move in parts]),
                np.concatenate([part.ends[cut] + move for part, cut, move in parts]),
            )
        reach *= 2


def concatenate_all(tokenizer, parts: list[Encoding]) -> Encoding:
    """Neighbours are joined level by level, as the text was cut."""
    while len(parts) > 1:
        parts = [
            concatenate(tokenizer, *parts[at:at + 2]) if at + 1 < len(parts) else parts[at]
            for at in range(0, len(parts), 2)
        ]
    return parts[0]


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(array) for array in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values.astype(np.int32)), type=_ARROW_INTS
    )


def _encoded(pairs: list[tuple[np.ndarray, str]]) -> pa.Array:
    fields = [pa.field("ids", _ARROW_INTS, False), pa.field("decoded", pa.string(), False)]
    return pa.StructArray.from_arrays(
        [_ints([ids for ids, _ in pairs]), pa.array([text for _, text in pairs], pa.string())],
        fields=fields,
    )


def _whole(path: str, text: Column) -> Column:
    @F.arrow_udf(ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _encoded([encode_text(path, one or "") for one in batch.to_pylist()])

    return encode(text)


def _leaf(path: str, text: Column) -> Column:
    @F.arrow_udf(LEAF)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _load(path)[0]
        for batch in batches:
            found = [Encoding.of(tokenizer, one) for one in batch.to_pylist()]
            names = ("ids", "starts", "ends")
            yield pa.StructArray.from_arrays(
                [_ints([getattr(one, name) for one in found]) for name in names],
                fields=[pa.field(name, _ARROW_INTS, False) for name in names],
            )

    return encode(text)


def _joined(path: str, leaves: Column) -> Column:
    @F.arrow_udf(ENCODED)
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer, words, _ = _load(path)
        for batch in batches:
            pairs = []
            for row in batch:
                parts = [
                    Encoding(
                        leaf["text"].as_py(),
                        *[
                            leaf["leaf"][name].values.to_numpy(zero_copy_only=False)
                            for name in ("ids", "starts", "ends")
                        ],
                    )
                    for leaf in row.values
                ]
                ids = concatenate_all(tokenizer, parts).ids
                pairs.append((ids, words.decode(ids.tolist())))
            yield _encoded(pairs)

    return join(leaves)


def encode_documents(
    docs: DataFrame, path: str, *, text: str = "text", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """The rows of ``docs`` with a struct column ``bpe`` (underscores if taken).

    Its fields are ``ids``, as the tokenizer file at ``path`` encodes the text without
    special tokens, truncation or padding, and ``decoded``, what it decodes them to.
    ``path`` must exist on every executor.

    Null, empty and blank texts have no ids and decode to an empty string. Equal long texts
    are encoded once; repeated rows stay rows. Null keys are not looked at. An empty table
    gives an empty table.
    """
    name = free_name(docs, "bpe")
    size = F.coalesce(F.length(text), F.lit(0))
    short = docs.where(size <= leaf_chars).withColumn(name, _whole(path, F.col(text)))

    # Leaves of long texts: halves of halves, so a power of two of them.
    long = docs.where(size > leaf_chars)
    hashes = [F.xxhash64(F.col(text)), F.xxhash64(F.lit("text"), F.col(text))]
    levels = F.ceil(F.log2(F.length("text") / F.lit(leaf_chars))).cast("int")
    count = F.pow(2, levels).cast("bigint")
    cut = F.floor(F.length("text") * F.col("at") / F.col("n")).cast("int")
    until = F.floor(F.length("text") * (F.col("at") + 1) / F.col("n")).cast("int")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = (
        long.select(hashes[0].alias("h1"), hashes[1].alias("h2"), F.col(text).alias("text"))
        .dropDuplicates(["h1", "h2"])
        .select("*", count.alias("n"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("at"))
        .select("h1", "h2", "at", F.substring("text", cut + 1, until - cut).alias("text"))
        # The parts of one text go to different tasks; with a number these are not merged.
        .repartition(tasks, "h1", "h2", "at")
        .select("h1", "h2", "at", "text", _leaf(path, F.col("text")).alias("leaf"))
    )
    trees = leaves.groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list(F.struct("at", "text", "leaf"))).alias("leaves")
    ).select("h1", "h2", _joined(path, F.col("leaves")).alias("bpe"))
    of = F.col(f"d.{text}")
    encoded = long.alias("d").join(
        trees.alias("t"),
        (F.xxhash64(of) == F.col("t.h1")) & (F.xxhash64(F.lit("text"), of) == F.col("t.h2")),
    ).select("d.*", F.col("t.bpe").alias(name))
    return short.unionByName(encoded)
