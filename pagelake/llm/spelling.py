"""Spelling variants: words one letter apart, grouped under the far more frequent form.

Words are near if one inserted, deleted or replaced letter makes one the other. Seen as a
multiset of its letters, a word is a binary vector with a place for every (letter, how
many of it came before); one edit changes at most two places.

*PartEnum.* The places are dealt to ``PARTS`` parts by a hash. Two vectors that differ in
at most two places agree on all but two parts. So a word has a signature for every choice
of two parts to leave out: a hash of its places in all the others. Near words have a
signature in common, whatever the edit; words are joined by equal signatures, and the pairs
are verified letter by letter before they leave the join.

Many words are rearrangements of the same syllables, which letter multisets cannot tell
apart. As the one edit lies in the first or in the second half of a word, near words also
have their last or their first ``AFFIX`` letters in common. Each signature is joined once
with either; with these letters fixed, the multisets are compared as before.
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

from pagelake.llm.tables import LOWER, UPPER, discard, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts that the places are dealt to, and places in which near words may differ.
PARTS = 4
DIFFERENCES = 2
#: Letters at one end that go with a signature; twice as many are no longer than a word.
AFFIX = 3


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_signatures(words: list[str], parts: int = PARTS) -> np.ndarray:
    """The signatures of each word, one row a word, one column a choice of parts left out."""
    sums = np.zeros((len(words), parts), np.uint64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(word) for word in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    # Equal letters of a word come together; a place is the letter and its number there.
    order = np.lexsort((letters, word))
    word, letters = word[order], letters[order].astype(np.uint64)
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    starts = np.flatnonzero(new)
    number = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    places = _mixed((letters << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
    part = (_mixed(places) % np.uint64(parts)).astype(np.int64)
    np.add.at(sums, (word, part), places)
    total = sums.sum(axis=1, dtype=np.uint64)
    columns = []
    for choice, left_out in enumerate(combinations(range(parts), DIFFERENCES)):
        rest = total - sums[:, list(left_out)].sum(axis=1, dtype=np.uint64)
        columns.append(_mixed(rest ^ _mixed(np.full(1, choice + 1, np.uint64))))
    return np.stack(columns, axis=1)


def signatures(word: Column, parts: int = PARTS) -> Column:
    """The signatures of a word as an array."""
    count = len(list(combinations(range(parts), DIFFERENCES)))

    @F.arrow_udf(T.ArrayType(T.LongType(), False))
    def of_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = word_signatures(batch.to_pylist(), parts)
            yield pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * count),
                pa.array(found.view(np.int64).ravel()),
                type=pa.list_(pa.field("element", pa.int64(), False)),
            )

    return of_words(word)


def _ends(word: Column, affix: int) -> list[Column]:
    return [F.substring(word, F.lit(1), F.lit(affix)), F.substring(word, F.lit(-affix), F.lit(affix))]


def counted_words(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 7,
    least_count: int = 2, every: int = 31,
) -> DataFrame:
    """(word, n): the words of all texts with their numbers of occurrences.

    A word is a maximal run of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z in lower case.
    Where ``every`` divides the CRC-32 of "key:run", the run loses the letter at that number
    modulo its length. A missing key is the empty string there.
    """
    # Runs that are too short as they are stay so; the others are looked for at the places
    # where a run starts, and only they are put in lower case.
    letter = "[A-Za-zÀ-ÿ]"
    runs = F.regexp_extract_all(
        F.col(text), F.lit(f"(?<!{letter}){letter}{{{max(1, least_chars)},}}+"), F.lit(0)
    )
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    word = F.when(
        F.pmod(h, F.lit(every)) == 0,
        F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run"))),
    ).otherwise(F.col("run"))
    return (
        docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), runs.alias("runs"))
        .select("id", F.explode("runs").alias("run"))
        .select("id", F.translate("run", UPPER, LOWER).alias("run"))
        .select(word.alias("word")).where(F.char_length("word") >= least_chars)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


def near_words(words: DataFrame, parts: int = PARTS, affix: int = AFFIX) -> DataFrame:
    """(a, n, b, m), a < b: the pairs of ``words`` (word, n) that are one edit apart.

    Words have at least twice ``affix`` letters.
    """
    first, last = _ends(F.col("word"), affix)
    # A key of 64 bits; should two be equal by chance, the pair fails the verification.
    signed = settle(
        words.select("word", "n", F.explode(signatures(F.col("word"), parts)).alias("signature"))
        .select("word", "n", F.explode(F.array(
            F.struct(F.lit(False).alias("tail"), F.xxhash64("signature", F.lit(0), first).alias("key")),
            F.struct(F.lit(True).alias("tail"), F.xxhash64("signature", F.lit(1), last).alias("key")),
        )).alias("k")).select("word", "n", "k.*"),
        "signatures",
    )
    # One scan, sorted once: both sides read the same columns.
    a, b = signed.toDF("a", "n", "tail", "key"), signed.toDF("b", "m", "tail", "key")
    sizes = F.char_length("a").between(F.char_length("b") - 1, F.char_length("b") + 1)
    # Words with equal beginnings are paired by these, and not once more by their ends.
    once = ~F.col("tail") | (_ends(F.col("a"), affix)[0] != _ends(F.col("b"), affix)[0])
    return (
        a.hint("merge").join(b, ["key", "tail"])
        .where((F.col("a") < F.col("b")) & sizes & once & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "n", "b", "m").distinct()
    )


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that lead on from each word.

    Every form is ``ratio`` times as frequent, so the chains are short; their lengths are
    doubled until none goes on.
    """
    roots = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(
            roots.join(on, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "roots",
        )
        discard(roots)
        roots = moved.select("word", "root")
        roots.settled_at = moved.settled_at
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 7,
    least_count: int = 2, every: int = 31, ratio: int = 10,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word, see :func:`counted_words`.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (of
    equally frequent ones the first by code points) if it occurs at least ``ratio`` times as
    often as the word, with ``form_n`` occurrences; both are null else. ``root`` is where
    following forms ends, the word itself if it has none. Null and empty texts have no
    words. Repeated rows count again. An empty table gives an empty table.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent, or following them may not end")
    if least_chars < 2 * AFFIX:
        raise ValueError("words must be twice as long as their affixes")
    words = settle(
        counted_words(docs, key=key, text=text, least_chars=least_chars,
                      least_count=least_count, every=every),
        "words",
    )
    pairs = settle(near_words(words), "near")
    both = pairs.toDF("word", "n", "near", "m").unionByName(pairs.toDF("near", "m", "word", "n"))
    best = F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best")
    nearest = settle(
        both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
        .withColumn("fits", -F.col("best.less") >= F.lit(ratio) * F.col("n"))
        .select(
            "word", "n_near", F.when(F.col("fits"), F.col("best.near")).alias("form"),
            F.when(F.col("fits"), -F.col("best.less")).alias("form_n"),
        ),
        "nearest",
    )
    roots = _followed(nearest.where("form IS NOT NULL"))
    discard(pairs)
    return (
        words.join(nearest, "word", "left").join(roots, "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
        )
    )
