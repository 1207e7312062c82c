"""Inverted index build: typed projection, postings, term dictionary, corpus size."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import analysis, times
from pagelake.sources.uri_tables import UriTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.LongType(),
}

DOCS_PER_BUCKET = 250_000

POSTINGS_SCHEMA = (
    "field string, term string, doc_id bigint, tf int, positions array<int>, n_terms int"
)
#: Words that a task holds and sorts at once.
ENTRIES_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class IndexField:
    """How one input column enters the index.

    ``indexed`` makes it searchable, ``stored`` makes it come back with a hit, and
    ``tokenized`` splits its text into words. The index knows it by ``name``, whatever
    the input column ``source`` is called. An unknown type means string; a date is RFC
    3339 text kept as epoch milliseconds.
    """

    name: str
    type: str = "string"
    source: str | None = None
    indexed: bool = False
    stored: bool = False
    tokenized: bool = False

    @property
    def data_type(self) -> T.DataType:
        return TYPES.get(self.type, T.StringType())

    @property
    def is_text(self) -> bool:
        return isinstance(self.data_type, T.StringType)

    def value(self) -> Column:
        column = F.col(self.source or self.name)
        if self.type == "date":
            return times.to_millis(column)
        return column.cast(self.data_type)


@dataclass(frozen=True)
class Index:
    """An index as four tables.

    ``docs``: doc_bucket, doc_id, stored fields and numeric indexed fields.
    ``postings``: field, term, doc_id, tf, positions, n_terms.
    ``terms``: field, term, df (partial sums; add them up per term).
    ``corpus``: n_docs (partial sums).
    ``neighbours``: left, field, term; see :mod:`pagelake.operators.fuzzy`.
    ``sample``: the postings of a few documents; see :func:`sampled`.
    """

    fields: tuple[IndexField, ...]
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int
    neighbours: UriTable | None = None
    neighbour_edits: int = 0
    sample: DataFrame | None = None

    def stored_names(self) -> list[str]:
        return [field.name for field in self.fields if field.stored]

    def stored(self) -> DataFrame:
        """What a reader sees of a document: its id and its stored fields only."""
        return self.docs.select("doc_id", *self.stored_names())


def fields_to_json(fields: tuple[IndexField, ...]) -> str:
    return json.dumps([asdict(field) for field in fields])


def fields_from_json(text: str) -> tuple[IndexField, ...]:
    return tuple(IndexField(**entry) for entry in json.loads(text))


def bucket_count(n_docs: int) -> int:
    return max(1, -(-n_docs // DOCS_PER_BUCKET))


def doc_bucket(doc_id: Column, buckets: int) -> Column:
    """The partition a document's stored fields live in."""
    return F.pmod(F.xxhash64(doc_id.cast("bigint")), F.lit(buckets)).cast("int")


def project(documents: DataFrame, key: str, fields: tuple[IndexField, ...]) -> DataFrame:
    """The typed index columns; columns outside the field list are dropped."""
    return documents.select(
        F.col(key).cast("bigint").alias("doc_id"), *[field.value().alias(field.name) for field in fields]
    )


def doc_fields(fields: tuple[IndexField, ...]) -> list[IndexField]:
    """The fields a document row keeps: stored ones, and numbers to search by."""
    return [field for field in fields if field.stored or (field.indexed and not field.is_text)]


def _counted(field: str, ids: pa.Array, entries: pa.ListArray) -> pa.RecordBatch:
    """The postings of a batch of documents by term; a term's documents stay in order."""
    sizes = pc.fill_null(pc.list_value_length(entries), 0).to_numpy()
    flat = entries.flatten()
    terms = flat.field("term").dictionary_encode()
    places = np.empty(len(terms.dictionary), np.int64)
    places[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(places))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keys = places[terms.indices.to_numpy()] * len(sizes) + rows
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    bounds = np.append(first, len(keys)).astype(np.int32)
    heads, of_row = pa.array(order[first]), rows[order[first]]
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(field, len(first)),
            terms.dictionary.take(terms.indices.take(heads)),
            ids.take(pa.array(of_row)),
            pa.array(np.diff(bounds)),
            pa.ListArray.from_arrays(pa.array(bounds), flat.field("position").take(pa.array(order))),
            pa.array(sizes[of_row].astype(np.int32)),
        ],
        names=["field", "term", "doc_id", "tf", "positions", "n_terms"],
    )


def _slices(entries: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Runs of documents with ``ENTRIES_AT_ONCE`` entries at most, or of one document."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(entries), 0).to_numpy())
    start, done = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + ENTRIES_AT_ONCE, "right")))
        yield start, stop - start
        start, done = stop, ends[stop - 1]


def build_postings(projected: DataFrame, fields: tuple[IndexField, ...]) -> DataFrame:
    """(field, term, doc_id, tf, positions, n_terms) of all indexed text fields.

    All fields share one scan, and a document's terms are counted where it lies: nothing is
    shuffled. Each task sorts its postings by term in runs, so that a later sort has only
    these to merge.
    """
    entry_type = "array<struct<term:string,position:int>>"

    def entries(field: IndexField) -> Column:
        value = F.col(field.name)
        if field.tokenized:
            return analysis.positioned_terms(value).cast(entry_type)
        whole = F.struct(value.alias("term"), F.lit(0).alias("position"))
        return F.when(value.isNotNull(), F.array(whole)).cast(entry_type)

    searchable = [field for field in fields if field.indexed and field.is_text]
    names = [field.name for field in searchable]

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in zip(names, batch.columns[1:]):
                for start, size in _slices(column):
                    yield _counted(name, batch.column(0).slice(start, size), column.slice(start, size))

    return projected.select(
        "doc_id", *[entries(field).alias(f"_{at}") for at, field in enumerate(searchable)]
    ).mapInArrow(postings, POSTINGS_SCHEMA)


#: One document in so many is indexed beforehand to see how terms are distributed.
SAMPLE = 64


def sampled(rows: DataFrame) -> DataFrame:
    """The rows of one document in ``SAMPLE``."""
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)


def term_dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def build_index(
    documents: DataFrame, key: str, fields: list[IndexField] | tuple[IndexField, ...],
    buckets: int = 1,
) -> Index:
    """The index of a table, as lazy DataFrames. ``key`` must be unique and integral."""
    fields = tuple(fields)
    projected = project(documents, key, fields)
    postings = build_postings(projected, fields)
    return Index(
        fields=fields,
        docs=projected.select(
            doc_bucket(F.col("doc_id"), buckets).alias("doc_bucket"),
            "doc_id",
            *[field.name for field in doc_fields(fields)],
        ),
        postings=postings,
        terms=term_dictionary(postings),
        corpus=projected.agg(F.count(F.lit(1)).alias("n_docs")),
        buckets=buckets,
        sample=build_postings(sampled(projected), fields),
    )


def update_index(index: Index, field: str, term: str, replacement: Index) -> Index:
    """Delete the documents that contain ``term``, then add those of ``replacement``.

    Also gives way to a replacement document of the same id. Only the counts of terms
    in removed or added documents change; the rest of the dictionary is carried over.
    """
    matching = index.postings.filter(
        (F.col("field") == field) & (F.col("term") == term)
    ).select("doc_id")
    removed = matching.unionByName(replacement.docs.select("doc_id")).distinct()

    removed_terms = (
        index.postings.join(removed, "doc_id", "left_semi")
        .groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df"))
    )
    kept_docs = index.docs.join(removed, "doc_id", "left_anti")
    added_docs = replacement.docs.withColumn(
        "doc_bucket", doc_bucket(F.col("doc_id"), index.buckets)
    )
    docs = kept_docs.unionByName(added_docs)
    terms = (
        index.terms.unionByName(removed_terms).unionByName(replacement.terms)
        .groupBy("field", "term").agg(F.sum("df").alias("df"))
        .filter(F.col("df") > 0)
    )
    return Index(
        fields=index.fields,
        docs=docs,
        postings=index.postings.join(removed, "doc_id", "left_anti").unionByName(
            replacement.postings
        ),
        terms=terms,
        corpus=docs.agg(F.count(F.lit(1)).alias("n_docs")),
        buckets=index.buckets,
    )
