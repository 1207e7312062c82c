"""Languages of texts as mixtures, by expectation-maximisation over n-gram likelihoods.

Training counts letter trigrams (a word's letters with their neighbours, white space and
signs being one and the same) per language, hashed into ``BUCKETS`` numbers. A document is
a mixture: each of its words comes from one of the languages, language l with proportion
p_l. Expectation-maximisation estimates the proportions from the words' likelihoods. The
set of languages is selected by penalised likelihood: sets grow by the languages'
proportions, each is estimated anew, and the one with the smallest
``-2 log L + PENALTY * |set| * log(words)`` stays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers that trigrams are hashed to; with the number of languages it bounds the model.
BUCKETS = 1 << 16
#: Added to each count.
SMOOTHING = 0.1
#: Weight of the penalty for each language of a set.
PENALTY = 1.0
ROUNDS = 12
UNKNOWN = "und"

_BATCH_CHARS = 1_000_000
_letters: list[np.ndarray] = []

MIXTURE = T.StructType([
    T.StructField("lang", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("langs", T.ArrayType(T.StringType(), False), False),
    T.StructField("shares", T.ArrayType(T.DoubleType(), False), False),
])


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter(
            (chr(code).isalpha() for code in range(0x110000)), bool, 0x110000
        ))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and for each its word's number and its text's number."""
    joined = " " + " ".join(text.lower() for text in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(text.lower()) + 1 for text in texts])
    letter = _letter_table()[codes]
    plain = np.where(letter, codes, 32).astype(np.uint32)
    middle = np.flatnonzero(letter)
    mixed = (
        plain[middle - 1] * np.uint32(0x9E3779B1) ^ plain[middle] * np.uint32(0x85EBCA77)
        ^ plain[middle + 1] * np.uint32(0xC2B2AE3D)
    )
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    hashed = (mixed >> np.uint32(16)).astype(np.int64) % BUCKETS
    starts = letter & ~np.append(False, letter[:-1])
    word = np.cumsum(starts)[middle] - 1
    text_of = np.searchsorted(np.cumsum(sizes), middle - 1, side="right")
    return hashed, word, text_of


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > _BATCH_CHARS:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for name, group in frame.groupby("lang", sort=False):
                found = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for part in _parts(group["text"].tolist()):
                    found += np.bincount(trigrams(part)[0], minlength=BUCKETS)
        for name, found in sums.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(used.astype(np.int32)),
                 pa.array(found[used])],
                names=["lang", "bucket", "n"],
            )

    counted = rows.select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).mapInArrow(count, "lang string, bucket int, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities of trigrams: BUCKETS times as many numbers as languages."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs

    @classmethod
    def fit(cls, docs: DataFrame, *, text: str = "text", lang: str = "lang") -> LanguageModel:
        """Learn from all rows of ``docs`` that have a text and a language."""
        counts = count_trigrams(docs, text, lang).toPandas()  # BUCKETS rows per language
        langs = sorted(counts["lang"].unique())
        table = np.full((BUCKETS, len(langs)), SMOOTHING)
        column = counts["lang"].map({name: at for at, name in enumerate(langs)})
        table[counts["bucket"], column] += counts["n"]
        return cls(langs, np.log(table / table.sum(axis=0)).astype(np.float32))

    def predict(self, text: Column) -> Column:
        """A struct of MIXTURE: the leading language, its share, and the selected set.

        Null texts, texts without a letter, and all texts if nothing was learned, are
        ``und`` with score 0 and an empty set. Ties go to the first name in order. Rows are
        judged one by one; equal texts have equal results.
        """
        langs, logs = self.langs, self.logs

        @F.pandas_udf(MIXTURE)
        def mixture(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in batches:
                texts = [one or "" for one in series.tolist()]
                shares = np.concatenate(
                    [_mixtures(part, logs) for part in _parts(texts)] or [np.zeros((0, 1))]
                )
                rows = []
                for row in shares:
                    chosen = np.flatnonzero(row > 0)
                    if len(chosen):
                        by = chosen[np.argsort(-row[chosen], kind="stable")]
                        rows.append((
                            langs[by[0]], float(row[by[0]]), [langs[at] for at in by],
                            row[by].astype(float).tolist(),
                        ))
                    else:
                        rows.append((UNKNOWN, 0.0, [], []))
                yield pd.DataFrame(rows, columns=[f.name for f in MIXTURE.fields])

        return mixture(text)


def _estimate(
    likely: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document by expectation-maximisation, and the log-likelihood.

    ``likely`` has one row per word, the documents' words from ``starts`` on; a language
    whose share is 0 at the outset stays out.
    """
    document = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(ROUNDS):
        joint = likely * shares[document]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
        moved = np.abs(new - shares).max()
        shares = new.astype(np.float32)
        if moved < 1e-3:
            break
    total = np.log((likely * shares[document]).sum(axis=1))
    return shares, np.add.reduceat(total, starts)


def _mixtures(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Shares of the selected languages for each text; zeros where there is no letter."""
    count = logs.shape[1]
    out = np.zeros((len(texts), max(count, 1)))
    if not count:
        return out
    grams, word, text_of = trigrams(texts)
    if not len(grams):
        return out
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    scores = np.add.reduceat(logs[grams], first, axis=0)
    # A floor keeps every language possible for every word.
    likely = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
    texts_with, starts, sizes = np.unique(text_of[first], return_index=True, return_counts=True)
    shares, _ = _estimate(
        likely, starts, sizes, np.full((len(sizes), count), 1 / count, np.float32)
    )
    out[texts_with] = _selected(likely, starts, sizes, shares)
    return out


def _selected(
    likely: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray
) -> np.ndarray:
    """Shares within the set of languages of least penalised likelihood."""
    ranks = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    best = (ranks == 0).astype(np.float32)
    # Where all words but less than half of one are of one language, no larger set can pay.
    open_ = np.flatnonzero((1 - shares.max(axis=1)) * sizes >= 0.5)
    if not len(open_):
        return best
    document = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.isin(document, open_)
    likely, ranks = likely[rows], ranks[open_]
    shares, sizes = shares[open_], sizes[open_]
    starts = np.cumsum(sizes) - sizes
    least = np.full(len(open_), np.inf)
    for size in range(1, likely.shape[1] + 1):
        inside = ranks < size
        start = np.where(inside, np.maximum(shares, 1e-3), 0)
        start = (start / start.sum(axis=1, keepdims=True)).astype(np.float32)
        found, fit = _estimate(likely, starts, sizes, start)
        cost = -2 * fit + PENALTY * size * np.log(sizes + 1)
        better = cost < least - 1e-6
        least[better] = cost[better]
        best[open_[better]] = found[better]
    return best
