"""Many searches at once: the best documents of every query, most documents never scored.

A document's score for a query is a sum over the words they share, times the share of the
query's words that it has. What a word can add at most is known beforehand: its weight in
the query times its largest strength, in all documents of a length class or in a block of
them. Strengths differ by length more than by anything else, so a class has documents with
the same length norm; a block is the part of a class that a hash deals out, so that a
frequent word's postings are spread over many blocks.

The parts are gone through in a few rounds, from few parts to many. In each round:

1. *Thresholds.* The score of rank ``limit`` so far is one that the result reaches for sure.
2. *Words.* The words that together cannot lift a document of a class to the threshold are
   set aside: no document of that class is looked for by them. These are the frequent ones.
3. *Blocks.* Blocks in which the other words, with all words set aside, stay below the
   threshold are skipped.
4. *Documents.* In the blocks that are left the same bound is taken for each document from
   what it really has of the words in question.
5. Only documents that still may reach the threshold are scored with all words.

Bounds are compared with a margin above the rounding of scores, so no tie is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import analysis, scoring
from pagelake.operators.index import Index
from pagelake.session import written

#: Documents of all lengths that share a part of the hash, about.
PART_DOCS = 256
#: Of so many slices of the parts, the rounds take the first, the next three, and the rest.
SLICES = 16
ROUNDS = ((0, 1), (1, 4), (4, SLICES))
#: More than scores differ by rounding and by the order of their sums.
MARGIN = 3 * 10.0 ** -scoring.SCORE_DIGITS

#: Share of the threshold that the words set aside may make up together.
ASIDE = 0.1

BLOCK = ["length_class", "part"]


@dataclass(frozen=True)
class BatchSearch:
    """``hits``: (query_id, doc_id, score, rank). ``looked_at``: (query_id, doc_id) whose
    bound was computed; ``scored``: those that were scored with all words.
    """

    hits: DataFrame
    looked_at: DataFrame
    scored: DataFrame


def _query_words(index: Index, queries: DataFrame, field: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, uses, weight) of words that documents have; the queries' lengths."""
    n_docs = index.corpus.agg(F.sum("n_docs").alias("n_docs")).first()["n_docs"] or 0
    words = queries.select(
        "query_id", F.explode(analysis.terms(F.col(text))).alias("term")
    ).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("uses"))
    dictionary = index.terms.filter(F.col("field") == field).groupBy("term").agg(
        F.sum("df").alias("df")
    )
    idf = scoring.idf_column(F.lit(float(n_docs)), F.coalesce(F.col("df"), F.lit(0)))
    weighed = written(words.join(dictionary, "term", "left").withColumn("idf", idf), "batch-words")
    known = weighed.filter(F.col("df").isNotNull()).select(
        "query_id", "term", "uses", (F.pow("idf", F.lit(2.0)) * F.col("uses")).alias("weight")
    )
    per_query = weighed.groupBy("query_id").agg(
        F.sum("uses").alias("n_clauses"),
        F.sqrt(F.sum(F.col("uses") * F.pow("idf", F.lit(2.0)))).alias("query_length"),
    )
    return known, per_query


def _postings(index: Index, field: str, known: DataFrame) -> DataFrame:
    """(term, doc_id, strength, block, slice) of the words that any query has."""
    n_docs = index.corpus.agg(F.sum("n_docs").alias("n_docs")).first()["n_docs"] or 0
    parts = SLICES * max(1, n_docs // (SLICES * PART_DOCS))
    norm = scoring.length_norm(F.col("n_terms"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    rows = (
        index.postings.filter(F.col("field") == field)
        .join(known.select("term").distinct(), "term", "left_semi")
        .select(
            "term", "doc_id", (F.sqrt(F.col("tf").cast("double")) * norm).alias("strength"),
            # Norms have two binary digits, so this tells all of them apart.
            F.floor(-8 * F.log2(norm)).cast("int").alias("length_class"), part.alias("part"),
        )
    )
    return written(rows.withColumn("slice", F.col("part") % SLICES), "batch-postings")


def _score(total: Column, matched: Column) -> Column:
    return total * matched / F.col("n_clauses") / F.col("query_length")


def _best(scored: DataFrame, limit: int) -> DataFrame:
    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= limit)


def _plan(words: DataFrame, best: DataFrame | None, limit: int) -> DataFrame:
    """``words`` with ``least``, what a score must reach, and whether a word is set aside:
    from the least valuable word of a class up, as long as together they stay below it."""
    nothing = F.lit(float("-inf"))
    if best is None:
        asked = words.withColumn("least", nothing)
    else:
        reached = best.filter(F.col("rank") == limit).select(
            "query_id", (F.col("score") - MARGIN).alias("least")
        )
        asked = words.join(reached, "query_id", "left").withColumn(
            "least", F.coalesce("least", nothing)
        )
    upwards = W.partitionBy("query_id", "length_class").orderBy("most", "term").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    bound = _score(F.sum("most").over(upwards), F.sum("uses").over(upwards))
    return asked.withColumn("aside", bound < F.col("least") * ASIDE)


def _round(
    plan: DataFrame, postings: DataFrame, bounds: DataFrame, per_query: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Looked at, candidates, and their scores, among the documents of ``postings``."""
    of_class = ["query_id", "length_class"]
    rest = plan.groupBy(*of_class, "n_clauses", "query_length", "least").agg(
        F.coalesce(F.sum(F.when(F.col("aside"), F.col("most"))), F.lit(0.0)).alias("rest"),
        F.coalesce(F.sum(F.when(F.col("aside"), F.col("uses"))), F.lit(0)).alias("rest_uses"),
    )
    leading = plan.filter("NOT aside").select(*of_class, "term", "uses", "weight")

    def possible(found: DataFrame) -> DataFrame:
        """Rows with ``sum`` and ``matched`` that may reach their query's threshold."""
        most = _score(F.col("sum") + F.col("rest"), F.col("matched") + F.col("rest_uses"))
        return found.join(rest, of_class).filter(most >= F.col("least"))

    def summed(strength: str) -> list[Column]:
        return [F.sum(F.col(strength) * F.col("weight")).alias("sum"), F.sum("uses").alias("matched")]

    blocks = possible(
        leading.join(bounds, ["term", "length_class"]).groupBy("query_id", *BLOCK).agg(*summed("top"))
    ).select("query_id", *BLOCK)
    wanted = leading.join(blocks, of_class)
    looked_at = written(
        wanted.join(postings, ["term", *BLOCK]).groupBy(*of_class, "doc_id").agg(*summed("strength")),
        "batch-documents",
    )
    candidates = written(
        possible(looked_at).select(*of_class, "doc_id", "sum", "matched"), "batch-candidates"
    )
    # The words set aside are looked up for the documents that are left.
    others = plan.filter("aside").select(*of_class, "term", "uses", "weight")
    more = candidates.join(others, of_class).join(
        postings.select("term", "doc_id", "strength"), ["term", "doc_id"]
    ).select(
        *of_class, "doc_id", (F.col("strength") * F.col("weight")).alias("sum"),
        F.col("uses").alias("matched"),
    )
    total = candidates.unionByName(more).groupBy("query_id", "doc_id").agg(
        F.sum("sum").alias("sum"), F.sum("matched").alias("matched")
    )
    score = F.round(_score(F.col("sum"), F.col("matched")), scoring.SCORE_DIGITS)
    scored = total.join(per_query, "query_id").select("query_id", "doc_id", score.alias("score"))
    return looked_at, candidates, scored


def search_batch(
    index: Index, queries: DataFrame, field: str, limit: int, text: str = "text"
) -> BatchSearch:
    """Best ``limit`` hits of every (query_id, text) row, any word matching.

    Queries are analysed like documents. Queries without a known word have no hits; those
    with fewer matching documents than ``limit`` have all of them.
    """
    known, per_query = _query_words(index, queries, field, text)
    postings = _postings(index, field, known)
    bounds = written(
        postings.groupBy("term", *BLOCK, "slice").agg(F.max("strength").alias("top")), "batch-bounds"
    )
    tops = bounds.groupBy("term", "length_class").agg(F.max("top").alias("top"))
    words = written(
        known.join(tops, "term").join(per_query, "query_id")
        .withColumn("most", F.col("weight") * F.col("top")).drop("top"),
        "batch-plan",
    )
    best, looked_at, scored = None, [], []
    for first, end in ROUNDS:
        within = (F.col("slice") >= first) & (F.col("slice") < end)
        seen, candidates, scores = _round(
            _plan(words, best, limit), postings.filter(within), bounds.filter(within), per_query
        )
        if best is not None:
            scores = best.select("query_id", "doc_id", "score").unionByName(scores)
        best = written(_best(scores, limit), "batch-best")
        looked_at.append(seen.select("query_id", "doc_id"))
        scored.append(candidates.select("query_id", "doc_id"))
    return BatchSearch(
        hits=best, looked_at=reduce(DataFrame.unionByName, looked_at),
        scored=reduce(DataFrame.unionByName, scored),
    )
