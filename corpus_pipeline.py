"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``docs``; where a text changes and there is a column ``n_chars``
it follows. Documents are never dropped but by the quality rules and as near copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import debruijn, line_dedup, packing, repetition, simhash
from pagelake.llm.tables import free_name, read, settle, short_batches


def _with_text(docs: DataFrame, changed: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` from ``changed``, which has more, with another ``text``."""
    columns = [
        text.alias(name) if name == "text"
        else F.length(text).cast(dict(docs.dtypes)[name]).alias(name) if name == "n_chars"
        else F.col(f"`{name}`")
        for name in docs.columns
    ]
    return changed.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves go; null texts fail."""
    short_batches(spark)
    judged = repetition.judge_quality(docs)
    return judged.where(F.col(free_name(docs, "quality"))["kept"]).select(
        *[f"`{name}`" for name in docs.columns]
    )


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from all of them.

    A null text stays null. A document of shared lines only keeps its row, with no text.
    """
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10)
    text = F.when(F.col("text").isNotNull(), F.col(free_name(docs, "line_kept")))
    return _with_text(docs, kept, text)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays.

    Near copies are linked by fingerprints of three-word shingles that differ in at most
    three bits. Rows are near copies by their texts only, whatever their doc_ids; a null
    doc_id comes last. Null and blank texts are near copies of each other.
    """
    short_batches(spark)
    return simhash.one_of_each(docs, width=3, radius=3)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of twenty words that also starts earlier go.

    A text that loses words has its remaining words joined by blanks; others are unchanged.
    Every row stays, also one that has no words left; null texts stay null. Different texts
    of one doc_id, or of none, are documents of their own, ordered by a hash; repeated rows
    are one place and do not remove each other's words. No rows give no rows.
    """
    short_batches(spark)
    found = debruijn.remove_repeats(docs, window=20)
    repeats = F.col(free_name(docs, "repeats"))
    text = F.when(repeats["n_removed"] > 0, repeats["kept"]).otherwise(F.col("text"))
    return _with_text(docs, found, text)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it.

    Null and empty texts are one piece of one token. Repeated rows and rows that share a
    doc_id, or have none, are pieces of their own; which of equally long pieces comes first
    is open. No rows give no rows.
    """
    short_batches(spark)
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), 2048,
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", shared_lines),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", shared_passages),
    ("best_fit_packing", packed),
]

#: Packing and similarity over tokenized and shingled text are not expressible in SQL; the
#: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
