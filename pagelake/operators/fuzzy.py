"""Dictionary terms within a few edits of a word, by deletion neighbourhoods.

If two words are at most ``edits`` insertions, deletions and replacements apart, dropping at
most that many letters from each can make them equal. This also holds for their beginnings
of equal length. So every dictionary term is filed under all that is left of its first
``PREFIX`` letters when up to ``edits`` of them are dropped; a word is looked up by its own
leftovers, by equality, and the terms found are verified by their distance.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.index import Index
from pagelake.sources.uri_tables import write_uri_table

#: Letters from which some are dropped: 37 leftovers at most for two edits.
PREFIX = 8
#: Leftovers in one file of the table.
ROWS_PER_FILE = 2_000_000


def _one_dropped(text: Column) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.char_length(text)), lambda at: at > 0)
    return F.transform(places, lambda at: F.concat(
        F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.char_length(text))
    ))


def leftovers(term: Column, edits: int) -> Column:
    """What is left of a term's beginning when up to ``edits`` of its letters are dropped."""
    found = level = F.array(F.substring(term, 1, PREFIX))
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, _one_dropped)))
        found = F.array_union(found, level)
    return found


def with_neighbours(index: Index, edits: int = 2) -> Index:
    """The index with a table of its terms' leftovers, for fuzzy queries of up to ``edits``.

    The table is built once, from the dictionary alone, and serves any number of queries.
    """
    terms = index.terms.select("field", "term").distinct()
    rows = terms.select("field", "term", F.explode(leftovers(F.col("term"), edits)).alias("left"))
    tasks = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(tasks, -(-40 * terms.count() // ROWS_PER_FILE))
    return replace(
        index, neighbours=write_uri_table(rows, "leftovers", files, "left"), neighbour_edits=edits
    )


def close_terms(index: Index, field: str, value: str, edits: int) -> DataFrame:
    """(term): the dictionary terms of a field within ``edits`` of ``value``."""
    spark = index.docs.sparkSession
    in_field = F.col("field") == field
    near = F.levenshtein("term", F.lit(value), edits) >= 0
    if index.neighbours is None or edits > index.neighbour_edits:
        # Without the table the distance is taken of every term of about the length.
        size = F.char_length("term").between(len(value) - edits, len(value) + edits)
        return index.terms.filter(in_field & size & near).select("term").distinct()
    # A few dozen strings, whatever the dictionary.
    own = spark.range(1).select(F.explode(leftovers(F.lit(value), edits)).alias("left"))
    filed = index.neighbours.holding(own).filter(in_field)
    return filed.join(F.broadcast(own), "left", "left_semi").filter(near).select("term").distinct()
