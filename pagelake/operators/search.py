"""Ranked search over an index: structured queries to DataFrames.

Queries are small immutable objects. Each turns into the documents it matches with one
score per document; combining them is one aggregation on ``doc_id``. Looking up a few
terms in the sorted postings is a pruned Parquet scan, so a search reads in proportion
to the query, not to the corpus.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field as dataclass_field
from functools import cached_property, reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import analysis, scoring, times
from pagelake.operators.index import Index, doc_bucket
from pagelake.operators.ordering import number_all
from pagelake.operators.predicates import MUST, MUST_NOT, SHOULD
from pagelake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FUZZY_EDITS = 2
#: Terms of a fuzzy query that may become constants of a scan.
CONSTANT_TERMS = 500


class Query:
    """Base of all queries."""

    boost: float = 1.0


@dataclass(frozen=True)
class Term(Query):
    """The field holds exactly this term; the term is not analysed."""

    field: str
    value: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Query):
    """The terms occur at consecutive positions (or at the given offsets).

    With ``slop`` they may be moved by so many positions against each other; then each
    place counts the less the more they are moved, and the terms must be different.
    """

    field: str
    terms: tuple[str, ...]
    offsets: tuple[int, ...] | None = None
    boost: float = 1.0
    slop: int = 0

    def placed(self) -> list[tuple[str, int]]:
        offsets = self.offsets or tuple(range(len(self.terms)))
        return list(zip(self.terms, offsets))


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    """``*`` stands for any run of characters and ``?`` for one; neither may lead.

    A backslash takes the next character as it is.
    """

    field: str
    pattern: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within ``edits`` single-character edits."""

    field: str
    value: str
    edits: int = FUZZY_EDITS
    boost: float = 1.0


@dataclass(frozen=True)
class TermRange(Query):
    """Terms between two bounds, which belong to it unless said otherwise; None is open."""

    field: str
    low: str | None
    high: str | None
    boost: float = 1.0
    with_low: bool = True
    with_high: bool = True

    def test(self) -> Column:
        term, tests = F.col("term"), [F.lit(True)]
        if self.low is not None:
            tests.append(term >= self.low if self.with_low else term > self.low)
        if self.high is not None:
            tests.append(term <= self.high if self.with_high else term < self.high)
        return reduce(lambda left, right: left & right, tests)


@dataclass(frozen=True)
class NumericRange(Query):
    """A numeric field between two bounds, both included."""

    field: str
    low: int | float
    high: int | float
    boost: float = 1.0


@dataclass(frozen=True)
class Boolean(Query):
    """Clauses as (query, occur) pairs."""

    clauses: tuple[tuple[Query, str], ...] = dataclass_field(default_factory=tuple)
    boost: float = 1.0


def term_query(field: str, value: str) -> Term:
    return Term(field, value)


def numeric_range_query(field: str, low, high) -> NumericRange | None:
    """None for an invalid range: a missing bound, mixed types, or high below low."""
    if low is None or high is None or type(low) is not type(high) or high < low:
        return None
    return NumericRange(field, low, high)


def date_range_query(
    spark: SparkSession, field: str, start: str, end: str
) -> NumericRange | None:
    """A range over a date field, from RFC 3339 texts."""
    bounds = spark.range(1).select(
        times.to_millis(F.lit(start)).alias("low"), times.to_millis(F.lit(end)).alias("high")
    ).first()
    return numeric_range_query(field, bounds["low"], bounds["high"])


def boolean_query(*pairs) -> Boolean | None:
    """From alternating queries and occurs; None when unpaired or empty."""
    if not pairs or len(pairs) % 2:
        return None
    clauses = tuple(zip(pairs[0::2], pairs[1::2]))
    unknown = [occur for _, occur in clauses if occur not in (MUST, SHOULD, MUST_NOT)]
    if unknown:
        raise ValueError(f"unknown occur: {unknown[0]!r}")
    return Boolean(clauses)


def text_query(
    spark: SparkSession, field: str, text: str, phrase: bool = False
) -> Query | None:
    """Plain words, analysed like the field's own text; any of them may match."""
    entries = spark.range(1).select(
        analysis.positioned_terms(F.lit(text)).alias("entries")
    ).first()["entries"]
    words = [(entry["term"], entry["position"]) for entry in entries]
    if not words:
        return None
    if len(words) == 1:
        return Term(field, words[0][0])
    if phrase:
        start = words[0][1]
        return Phrase(
            field, tuple(term for term, _ in words), tuple(at - start for _, at in words)
        )
    return Boolean(tuple((Term(field, term), SHOULD) for term, _ in words))


def _leaves(query: Query):
    """All scoring leaves of a query."""
    if isinstance(query, Boolean):
        for clause, occur in query.clauses:
            if occur != MUST_NOT:
                yield from _leaves(clause)
    else:
        yield query


def _looked_up(query: Query) -> set[tuple[str, str]]:
    pairs = set()
    for leaf in _leaves(query):
        if isinstance(leaf, Term):
            pairs.add((leaf.field, leaf.value))
        elif isinstance(leaf, Phrase):
            pairs.update((leaf.field, term) for term in leaf.terms)
    return pairs


def _any_term(pairs: set[tuple[str, str]]) -> Column:
    """Predicate for a set of (field, term) pairs, in a form Parquet can prune by."""
    by_field: dict[str, list[str]] = {}
    for field, term in sorted(pairs):
        by_field.setdefault(field, []).append(term)
    tests = [
        (F.col("field") == field) & F.col("term").isin(terms)
        for field, terms in by_field.items()
    ]
    return reduce(lambda left, right: left | right, tests)


class _Scorer:
    """Turns the parts of one query into (doc_id, score) DataFrames."""

    def __init__(self, index: Index, query: Query):
        self.index = index
        self.n_docs = index.corpus.agg(F.sum("n_docs")).first()[0] or 0
        pairs = _looked_up(query)
        self.doc_freq: dict[tuple[str, str], int] = {}
        if pairs:
            # At most one row per term of the query.
            found = index.terms.filter(_any_term(pairs)).groupBy("field", "term").agg(
                F.sum("df").alias("df")
            ).collect()
            self.doc_freq = {(row["field"], row["term"]): row["df"] for row in found}
        total = self.squared_weight(query)
        self.query_norm = 1.0 / math.sqrt(total) if total > 0 else 1.0

    def idf(self, field: str, term: str) -> float:
        return scoring.idf(self.n_docs, self.doc_freq.get((field, term), 0))

    def leaf_idf(self, leaf: Query) -> float:
        if isinstance(leaf, Term):
            return self.idf(leaf.field, leaf.value)
        if isinstance(leaf, Phrase):
            return sum(self.idf(leaf.field, term) for term in leaf.terms)
        return 1.0

    def squared_weight(self, query: Query) -> float:
        if isinstance(query, Boolean):
            inner = sum(
                self.squared_weight(clause)
                for clause, occur in query.clauses if occur != MUST_NOT
            )
            return inner * query.boost ** 2
        return (self.leaf_idf(query) * query.boost) ** 2

    def weight(self, leaf: Query, outer_boost: float) -> float:
        """What a leaf's term frequency and length norm are multiplied with."""
        boost = leaf.boost * outer_boost
        return self.leaf_idf(leaf) ** 2 * boost * self.query_norm

    def matches(self, query: Query, outer_boost: float = 1.0) -> DataFrame:
        """Matching documents, one row each, with their score."""
        if isinstance(query, Boolean):
            return self._boolean(query, outer_boost)
        if isinstance(query, Term):
            found = self._postings(_any_term({(query.field, query.value)}))
            return found.select("doc_id", self._term_score(query, outer_boost))
        if isinstance(query, Phrase):
            return self._phrase(query, outer_boost)
        constant = F.lit(float(query.boost * outer_boost * self.query_norm)).alias("score")
        return self._constant_matches(query).select("doc_id", constant)

    def _postings(self, predicate: Column) -> DataFrame:
        return self.index.postings.filter(predicate)

    def _term_score(self, term: Term, outer_boost: float) -> Column:
        frequency = F.sqrt(F.col("tf").cast("double"))
        norm = scoring.length_norm(F.col("n_terms"))
        return (frequency * norm * F.lit(self.weight(term, outer_boost))).alias("score")

    def _phrase(self, phrase: Phrase, outer_boost: float) -> DataFrame:
        placed = phrase.placed()
        found = self._postings(_any_term({(phrase.field, term) for term, _ in placed}))
        # Per document and word: the places where the phrase would have to start.
        starts = [
            F.max(F.when(F.col("term") == term, _shifted("positions", offset))).alias(
                f"starts_{at}"
            )
            for at, (term, offset) in enumerate(placed)
        ]
        per_doc = found.groupBy("doc_id").agg(*starts, F.first("n_terms").alias("n_terms"))
        lists = [F.col(f"starts_{at}") for at in range(len(placed))]
        if phrase.slop:
            frequency = _moved_frequency(lists, phrase.slop)
        else:
            frequency = F.size(reduce(F.array_intersect, lists))
        counted = per_doc.select(
            "doc_id", "n_terms", F.coalesce(frequency.cast("double"), F.lit(0.0)).alias("tf")
        ).filter(F.col("tf") > 0)
        frequency = F.sqrt(F.col("tf").cast("double"))
        norm = scoring.length_norm(F.col("n_terms"))
        weight = F.lit(self.weight(phrase, outer_boost))
        return counted.select("doc_id", (frequency * norm * weight).alias("score"))

    def _constant_matches(self, query: Query) -> DataFrame:
        """Documents of queries whose matches all score alike."""
        if isinstance(query, NumericRange):
            within = F.col(query.field).between(query.low, query.high)
            return self.index.docs.filter(within).select("doc_id")
        in_field = F.col("field") == query.field
        if isinstance(query, Prefix):
            found = self._postings(in_field & F.col("term").startswith(query.prefix))
        elif isinstance(query, Wildcard):
            found = self._postings(in_field & _wildcard(query.pattern))
        elif isinstance(query, TermRange):
            found = self._postings(in_field & query.test())
        elif isinstance(query, Fuzzy):
            found = self._fuzzy(query, in_field)
        else:
            raise TypeError(f"unknown query: {query!r}")
        return found.select("doc_id").distinct()

    def _fuzzy(self, query: Fuzzy, in_field: Column) -> DataFrame:
        """Postings of all dictionary terms within the edit distance.

        A few terms become constants of the scan, so that only their postings are read; if
        there are many they are joined.
        """
        from pagelake.operators.fuzzy import close_terms

        close = close_terms(self.index, query.field, query.value, query.edits)
        some = [row["term"] for row in close.limit(CONSTANT_TERMS + 1).collect()]
        if not some:
            return self.index.postings.limit(0)
        if len(some) <= CONSTANT_TERMS:
            return self._postings(_any_term({(query.field, term) for term in some}))
        return self._postings(in_field).join(close, "term", "left_semi")

    def _boolean(self, query: Boolean, outer_boost: float) -> DataFrame:
        boost = outer_boost * query.boost
        occurs = [occur for _, occur in query.clauses]
        parts = []
        terms: dict[tuple[str, str], list[int]] = {}
        for at, (clause, _) in enumerate(query.clauses):
            if isinstance(clause, Term):
                terms.setdefault((clause.field, clause.value), []).append(at)
            else:
                parts.append(
                    self.matches(clause, boost).select(
                        "doc_id", F.lit(at).alias("clause"), "score"
                    )
                )
        if terms:
            parts.append(self._term_clauses(query, terms, boost))
        tagged = reduce(DataFrame.unionByName, parts)

        def count_of(occur: str) -> Column:
            wanted = [at for at, name in enumerate(occurs) if name == occur]
            return F.count_if(F.col("clause").isin(wanted)) if wanted else F.lit(0)

        prohibited = [at for at, name in enumerate(occurs) if name == MUST_NOT]
        counts = F.lit(True) if not prohibited else ~F.col("clause").isin(prohibited)
        per_doc = tagged.groupBy("doc_id").agg(
            F.sum(F.when(counts, F.col("score"))).alias("sum"),
            count_of(MUST).alias("n_must"),
            count_of(SHOULD).alias("n_should"),
            count_of(MUST_NOT).alias("n_not"),
        )
        required = occurs.count(MUST)
        enough = (F.col("n_must") == required) & (F.col("n_not") == 0)
        if not required:
            enough = enough & (F.col("n_should") > 0)
        scoring_clauses = len(occurs) - len(prohibited)
        coord = (F.col("n_must") + F.col("n_should")) / F.lit(float(max(scoring_clauses, 1)))
        return per_doc.filter(enough).select("doc_id", (F.col("sum") * coord).alias("score"))

    def _term_clauses(
        self, query: Boolean, terms: dict[tuple[str, str], list[int]], boost: float
    ) -> DataFrame:
        """All term clauses in one scan of the postings."""
        found = self._postings(_any_term(set(terms)))
        frequency = F.sqrt(F.col("tf").cast("double"))
        norm = scoring.length_norm(F.col("n_terms"))
        clauses = F.lit(None).cast("array<struct<clause:int,weight:double>>")
        for (field, value), places in terms.items():
            listed = F.array(*[
                F.struct(
                    F.lit(at).alias("clause"),
                    F.lit(float(self.weight(query.clauses[at][0], boost))).alias("weight"),
                )
                for at in places
            ])
            same = (F.col("field") == field) & (F.col("term") == value)
            clauses = F.when(same, listed).otherwise(clauses)
        return found.select(
            "doc_id", (frequency * norm).alias("base"), F.inline(clauses)
        ).select("doc_id", "clause", (F.col("base") * F.col("weight")).alias("score"))


def _shifted(positions: str, offset: int) -> Column:
    return F.transform(positions, lambda at: at - F.lit(offset))


def moved_count(lists: list[list[int]], slop: int) -> float:
    """How often a phrase occurs with its words moved, from the starts each word asks for.

    Every word has a place; the word that is first goes on until it has passed another one.
    The nearest the places come together meanwhile is one occurrence, which counts the less
    the farther they are apart.
    """
    at, total = [0] * len(lists), 0.0
    while True:
        now = [places[place] for places, place in zip(lists, at)]
        first = min(range(len(lists)), key=lambda word: (now[word], word))
        last, nearest = max(now), min(now[:first] + now[first + 1:])
        apart, passed = last - now[first], False
        while not passed:
            at[first] += 1
            ended = at[first] == len(lists[first])
            passed = ended or lists[first][at[first]] > nearest
            if not passed:
                apart = last - lists[first][at[first]]
        total += 1.0 / (1 + apart) if apart <= slop else 0.0
        if ended:
            return total


def _moved_frequency(lists: list[Column], slop: int) -> Column:
    """:func:`moved_count` of a document's places; documents without all words have none."""

    @F.arrow_udf("double")
    def count(found: pa.Array) -> pa.Array:
        return pa.array([moved_count(row, slop) for row in found.to_pylist()], pa.float64())

    complete = reduce(lambda left, right: left & right, [places.isNotNull() for places in lists])
    # What is counted for other documents does not matter, but they must have places.
    places = [F.coalesce(F.array_sort(one), F.array(F.lit(0))) for one in lists]
    return F.when(complete, count(F.array(*places))).otherwise(F.lit(0.0))


def _wildcard(pattern: str) -> Column:
    """The pattern as LIKE, plus its literal head as a prefix Parquet can prune by."""
    if pattern[:1] in ("*", "?"):
        raise ValueError("a wildcard may not lead the pattern")
    like, head, literal, at = "", "", True, 0
    while at < len(pattern):
        mark = pattern[at]
        if mark in "*?":
            like, literal = like + ("%" if mark == "*" else "_"), False
        else:
            at += mark == "\\" and at + 1 < len(pattern)
            like += "\\" + pattern[at] if pattern[at] in "\\%_" else pattern[at]
            head += pattern[at] if literal else ""
        at += 1
    return F.col("term").startswith(head) & F.col("term").like(like)


@dataclass(frozen=True)
class SearchResult:
    """The best hits of a search, and how many documents matched in all.

    With a limit both come from one run over the matching documents: they are counted on
    their way to the selection of the best, which is written down.
    """

    index: Index
    matched: DataFrame
    limit: int | None
    after: tuple[float, int] | None = None

    @cached_property
    def _run(self) -> tuple[DataFrame, int]:
        """(rank, doc_id, score) of the best hits, and the number of all."""
        order = [F.desc("score"), F.asc("doc_id")]
        seen = Observation()
        counted = self.matched.observe(seen, F.count(F.lit(1)).alias("rows"))
        best = self._remaining(counted).orderBy(*order).limit(self.limit)
        ranked = best.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "doc_id", "score")
        hits = written(ranked, "hits")
        if hits.isEmpty():
            # A plan that is known to be empty does not run, and then nothing is counted.
            return hits, 0 if self.after is None and self.limit else self.matched.count()
        return hits, seen.get["rows"]

    def _remaining(self, matched: DataFrame) -> DataFrame:
        if self.after is None:
            return matched
        score, doc_id = self.after
        cut = round(float(score), scoring.SCORE_DIGITS)
        return matched.filter(
            (F.col("score") < cut) | ((F.col("score") == cut) & (F.col("doc_id") > doc_id))
        )

    @cached_property
    def total_hits(self) -> int:
        return self.matched.count() if self.limit is None else self._run[1]

    @cached_property
    def hits(self) -> DataFrame:
        """(rank, doc_id, score) in order of falling score, then rising id."""
        if self.limit is not None:
            return self._run[0]
        numbered = number_all(self._remaining(self.matched), [F.desc("score"), F.asc("doc_id")])
        return numbered.select(F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    @cached_property
    def docs(self) -> DataFrame:
        """The hits with their stored fields, in hit order."""
        return fetch_hits(self.index, self.hits)

    def to_df(self) -> DataFrame:
        return self.docs.withColumn("total_hits", F.lit(self.total_hits).cast("bigint"))


def fetch_hits(index: Index, hits: DataFrame) -> DataFrame:
    """Stored fields for (rank, doc_id, score) rows, in rank order.

    Joining on the bucket as well lets Spark read only the buckets that hold a hit.
    """
    placed = hits.withColumn("doc_bucket", doc_bucket(F.col("doc_id"), index.buckets))
    joined = placed.join(index.docs, ["doc_bucket", "doc_id"], "inner")
    names = [name for name in index.stored_names()]
    return joined.select("rank", "doc_id", "score", *names).orderBy(
        "rank", F.desc("score"), "doc_id"
    )


def ranked_rows(
    rows: DataFrame, order: list[str], descending: list[bool], name: str = "rank"
) -> DataFrame:
    """Number all rows in a global order, without a single-task window."""
    keys = [
        F.desc(column) if falls else F.asc(column)
        for column, falls in zip(order, descending)
    ]
    return number_all(rows, keys, name)


def matching(index: Index, query: Query) -> DataFrame:
    """All documents a query matches, with scores rounded as they are returned."""
    scored = _Scorer(index, query).matches(query)
    return scored.select("doc_id", F.round("score", scoring.SCORE_DIGITS).alias("score"))


def matching_ids(index: Index, query: Query) -> DataFrame:
    """The documents a query matches, as a filter for another search."""
    return matching(index, query).select("doc_id")


def search(
    index: Index, query: Query | None, limit: int | None = 10,
    filter: Query | None = None, after: tuple[float, int] | None = None,
) -> SearchResult:
    """Rank the documents that match ``query``.

    ``filter`` restricts the hits without touching their scores. ``after`` is the
    (score, doc_id) of the last hit already seen; the total still counts everything.
    """
    if query is None:
        nothing = index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        return SearchResult(index, nothing, limit)
    matched = matching(index, query)
    if filter is not None:
        matched = matched.join(matching_ids(index, filter), "doc_id", "left_semi")
    return SearchResult(index, matched, limit, after)


def search_text(
    index: Index, field: str, text: str | None, limit: int | None = 10,
    filter: Query | None = None, after: tuple[float, int] | None = None,
) -> SearchResult | None:
    """Search by a query text; see :mod:`pagelake.operators.query_text` for its forms.

    No hits for an empty text or one that starts with a wildcard; None for a malformed
    one, such as one with an unclosed quote or bracket.
    """
    spark = index.docs.sparkSession
    if not text or text[0] in "*?":
        return search(index, None, limit)
    from pagelake.operators.query_text import query_from_text

    well_formed, query = query_from_text(spark, field, text)
    return search(index, query, limit, filter, after) if well_formed else None


def search_batch(
    index: Index, queries: DataFrame, field: str, limit: int, text: str = "text"
) -> DataFrame:
    """Best ``limit`` hits of every (query_id, text) row, any word matching.

    See :mod:`pagelake.operators.batch_search` for how most documents are never scored.
    """
    from pagelake.operators import batch_search

    return batch_search.search_batch(index, queries, field, limit, text).hits
