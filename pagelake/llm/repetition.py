"""Quality rules: word and line counts, and repetition found with a suffix array.

The words of a document are sorted by suffix (prefix doubling over whole batches of
documents, in numpy), neighbouring suffixes get their longest common prefix, and a stack
walks the prefixes' intervals. An interval whose occurrences differ in the word before
them is a *maximal repeat*: a run of words found twice or more that cannot be extended.
The spans of all repeats of at least ``MIN_REPEAT`` words are united; the rule limits the
share of words they cover and the length of the longest one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.tables import WHITE, free_name

# Workers need not be able to import this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shortest repeat that counts, in words.
MIN_REPEAT = 10
#: Largest share of words that repeats may cover, and the longest allowed repeat in words.
MAX_COVERED = 0.3
MAX_LONGEST = 100

SYMBOLS = "#*$%&|<>"

#: Words that are sorted together; a longer document is sorted on its own.
_BATCH_WORDS = 200_000

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_repeat_words", T.LongType(), False),
    T.StructField("n_repeats", T.LongType(), False),
    T.StructField("covered", T.LongType(), False),
    T.StructField("longest", T.LongType(), False),
])


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and per level j the rank of each position's 2**j symbols.

    ``codes`` are symbols of which no two documents share one; ``ends`` gives for each
    position the end of its document. Equal ranks at level j mean equal runs of 2**j
    symbols. A run cut short by its document's end differs from all others there.
    """
    size = len(codes)
    order = np.argsort(codes, kind="stable")
    places = np.arange(size)
    first = np.empty(size, bool)
    first[:1] = True
    first[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, places, 0))
    levels = [rank.astype(np.int32)]
    alone = first & np.append(first[1:], True)
    active = order[~alone]
    step = 1
    while len(active):
        after = active + step
        inside = after < ends[active]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        old = rank[active]
        pair = old * (size + 2) + second
        by = np.argsort(pair, kind="stable")
        active, pair, old = active[by], pair[by], old[by]
        places = np.arange(len(active))
        new_group = np.append(True, pair[1:] != pair[:-1])
        old_group = np.append(True, old[1:] != old[:-1])
        group_at = np.maximum.accumulate(np.where(new_group, places, 0))
        old_at = np.maximum.accumulate(np.where(old_group, places, 0))
        rank = rank.copy()
        rank[active] = old + group_at - old_at
        levels.append(rank.astype(np.int32))
        alone = new_group & np.append(new_group[1:], True)
        active = active[~alone]
        step *= 2
    order = np.empty(size, np.int64)
    order[rank] = np.arange(size)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in ``order``."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    one, other = order[same], order[same - 1]
    length = np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + length, other + length
        inside = (a < ends[one]) & (b < ends[other])
        equal = np.zeros(len(same), bool)
        equal[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        length[equal] += 1 << level
    shared[same] = length
    return shared


def maximal_repeats(
    order: np.ndarray, shared: np.ndarray, before: np.ndarray, least: int
) -> Iterator[tuple[int, int, int]]:
    """(length, low, high) of each interval of ``order`` that is a maximal repeat.

    ``before`` names the symbol before each position, differently for each document start.
    """
    left = before[order]
    changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    long = np.flatnonzero(shared >= least)
    for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1) if len(long) else []:
        stack: list[tuple[int, int]] = []
        for at, length in zip([*run.tolist(), run[-1] + 1], [*shared[run].tolist(), 0]):
            low = at - 1
            while stack and stack[-1][0] > length:
                found, low = stack.pop()
                if changes[at - 1] > changes[low]:
                    yield found, low, at - 1
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, low))


def _united(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places the spans cover."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def _measure(words: list[list[bytes]], least: int) -> np.ndarray:
    """One row of MEASURES per document."""
    sizes = np.array([len(document) for document in words], np.int64)
    out = np.zeros((len(words), 5), np.int64)
    out[:, 0] = sizes
    size = int(sizes.sum())
    if not size:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter(
        (number.setdefault(word, len(number)) for document in words for word in document),
        np.int64, size,
    )
    document = np.repeat(np.arange(len(words)), sizes)
    bounds = np.cumsum(sizes)
    ends = np.repeat(bounds, sizes)
    codes = document * len(number) + ids
    order, levels = suffix_array(codes, ends)
    shared = common_prefixes(order, levels, ends)

    # The longest repeat that starts at a place: what its suffix shares with a neighbour.
    longest = np.empty(size, np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    windows = np.flatnonzero(longest >= 3)
    repeated = _united(windows, np.full(len(windows), 3), size)
    out[:, 1] = np.bincount(document[repeated], minlength=len(words))

    before = np.empty(size, np.int64)
    before[1:] = codes[:-1]
    starts = bounds - sizes
    occupied = starts[sizes > 0]
    before[occupied] = -1 - occupied
    for length, low, _ in maximal_repeats(order, shared, before, least):
        row = document[order[low]]
        out[row, 2] += 1
        out[row, 4] = max(out[row, 4], length)
    # Every repeat lies inside a maximal one, so the longest repeat at each place gives
    # the union of the maximal repeats' spans without listing all their occurrences.
    spans = np.flatnonzero(longest >= least)
    covered = _united(spans, longest[spans], size)
    out[:, 3] = np.bincount(document[covered], minlength=len(words))
    return out


def _measured(texts: list[str | None], least: int) -> np.ndarray:
    parts, pending, held = [], [], 0
    for text in texts:
        # On bytes, split() cuts exactly at the six ASCII white space characters.
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if pending and held + len(words) > _BATCH_WORDS:
            parts.append(_measure(pending, least))
            pending, held = [], 0
        pending.append(words)
        held += len(words)
    parts.append(_measure(pending, least))
    return np.concatenate(parts)


def repetition(text: Column, least: int = MIN_REPEAT) -> Column:
    """A struct of MEASURES for a text; a null, empty or blank text has zeros."""

    @F.pandas_udf(MEASURES)
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame(
                _measured(series.tolist(), least), columns=[f.name for f in MEASURES.fields]
            )

    return measure(text)


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def base_measures(text: Column) -> Column:
    """Struct of word_chars, n_symbols and n_dup_lines, as built-in expressions."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return F.struct(
        F.length(F.translate(body, WHITE, "")).cast("bigint").alias("word_chars"),
        _count_of(body, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
    )


def judge_quality(
    docs: DataFrame, *, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
    least: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The rows of ``docs`` with a struct column ``quality`` (underscores if taken).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in three-word
    windows found twice or more), n_repeats, covered and longest (maximal repeats of at
    least ``least`` words: their number, the words they cover, the longest), base_failed
    and kept. ``kept`` is false if the base rules fail, if repeats cover more than
    ``max_covered`` of the words, or if one is longer than ``max_longest`` words.

    A null, empty or blank text has zeros and fails the base rules. Rows are judged one by
    one: order, ties and repeated rows change nothing. Null keys are not looked at.
    """
    measured = free_name(docs, "measured_repetition")
    r, base = F.col(f"`{measured}`"), base_measures(F.col(text))
    failed = (r["n_words"] < min_words) | (
        100 * r["n_repeat_words"] > max_repeat_percent * r["n_words"]
    )
    repetitive = (r["covered"] > max_covered * r["n_words"]) | (r["longest"] > max_longest)
    quality = F.struct(
        r["n_words"].alias("n_words"),
        *[base[name].alias(name) for name in ("word_chars", "n_symbols", "n_dup_lines")],
        *[r[name].alias(name) for name in ("n_repeat_words", "n_repeats", "covered", "longest")],
        failed.alias("base_failed"), (~failed & ~repetitive).alias("kept"),
    )
    return (
        docs.withColumn(measured, repetition(F.col(text), least))
        .withColumn(free_name(docs, "quality"), quality).drop(measured)
    )
