"""Indexes on disk: Parquet tables under one folder, and a corpus table that says what counts.

Every write goes to a batch of its own with a name no other write has, and becomes part of
the index by one row in the corpus table, which is written last. Readers look only at the
batches of the newest generation in the corpus table. So what a failed write left behind is
never read, and replacing an index leaves the old one as it is until the new one is whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.operators.index import (
    POSTINGS_SCHEMA,
    SAMPLE,
    Index,
    IndexField,
    bucket_count,
    build_index,
    doc_bucket,
    doc_fields,
    fields_from_json,
    fields_to_json,
    sampled,
    term_dictionary,
)
from pagelake.session import path_exists, remove_path, written

CREATE, APPEND, CREATE_OR_APPEND = "create", "append", "create_or_append"

TERMS_SCHEMA = "field string, term string, df bigint"
DELETED_SCHEMA = "doc_id bigint"
CORPUS_SCHEMA = (
    "generation int, number int, batch string, n_docs bigint, buckets int, fields string, "
    "deletes boolean"
)
TABLES = ("postings", "terms", "docs", "deleted")


def index_exists(spark: SparkSession, path: str) -> bool:
    """The corpus table is written last, so its presence marks a complete index."""
    return path_exists(spark, f"{path}/corpus/_SUCCESS")


def _batches(spark: SparkSession, path: str) -> list:
    """The corpus rows of the newest generation, one per write, in order."""
    if not index_exists(spark, path):
        return []
    rows = spark.read.schema(CORPUS_SCHEMA).parquet(f"{path}/corpus").collect()
    newest = max(row["generation"] for row in rows)
    return sorted(
        (row for row in rows if row["generation"] == newest), key=lambda row: row["number"]
    )


def add_documents(
    documents: DataFrame, key: str, fields: list[IndexField], path: str,
    mode: str = CREATE_OR_APPEND, buckets: int | None = None,
) -> None:
    """Index ``documents`` into the folder ``path``.

    ``create`` replaces what is there, ``append`` needs an index to be there, and
    ``create_or_append`` takes either. An append needs the index's own fields, and ids
    that it does not hold yet; :func:`update_documents` replaces documents.
    """
    spark = documents.sparkSession
    if mode not in (CREATE, APPEND, CREATE_OR_APPEND):
        raise ValueError(f"unknown write mode: {mode}")
    exists = index_exists(spark, path)
    if mode == APPEND and not exists:
        raise FileNotFoundError(f"no index to append to: {path}")
    appending = exists and mode != CREATE
    if appending:
        current = read_index(spark, path)
        buckets = current.buckets
        if tuple(fields) != current.fields:
            raise ValueError("the fields differ from those of the index")
        ids = documents.select(F.col(key).cast("bigint").alias("doc_id"))
        if not current.docs.join(ids, "doc_id", "left_semi").isEmpty():
            raise ValueError("the index already holds documents with these ids")
    elif buckets is None:
        buckets = bucket_count(documents.count())
    save_index(build_index(documents, key, fields, buckets), path, appending)


def update_documents(
    documents: DataFrame, key: str, path: str, field: str, term: str
) -> None:
    """Delete the documents that contain ``term``, then add ``documents``, in place.

    Documents of the same id give way, too. Nothing that is there is rewritten: the write
    is one more batch, with the ids it deletes from the batches before it and the counts
    their terms lose. :func:`merge_index` makes one batch of all.
    """
    spark = documents.sparkSession
    current = read_index(spark, path)
    added = build_index(documents, key, current.fields, current.buckets)
    matching = current.postings.filter(
        (F.col("field") == field) & (F.col("term") == term)
    ).select("doc_id")
    gone = current.docs.select("doc_id").join(
        matching.unionByName(added.docs.select("doc_id")).distinct(), "doc_id", "left_semi"
    )
    save_index(added, path, appending=True, deleted=gone)


def merge_index(spark: SparkSession, path: str) -> None:
    """Write the index anew as one batch, without deletions."""
    save_index(read_index(spark, path), path)


#: Letters of a term that place it, and places up to which the table of them is broadcast.
LEAD = 3
MOST_PLACES = 200_000
POSTINGS_PER_FILE = 5_000_000


def _dealt(postings: DataFrame, sample: DataFrame, known: DataFrame | None) -> DataFrame:
    """``postings`` in partitions that are ranges of (field, start of the term).

    How many rows there are of each start is known from the dictionary of an index that
    is appended to, or estimated from the documents of a small sample; so the bounds need
    no look at the postings themselves. A start with more than a partition's share has
    several partitions, among which its terms' documents are dealt by a hash. Starts that
    were not seen go anywhere.
    """
    lead = F.substring("term", 1, LEAD).alias("lead")
    if known is None:
        weights = sample.groupBy("field", lead).agg((F.count(F.lit(1)) * SAMPLE).alias("rows"))
    else:
        weights = known.groupBy("field", lead).agg(F.sum("df").alias("rows"))
    weights = written(weights, "weights")
    total, places = weights.agg(F.sum("rows"), F.count(F.lit(1))).first()
    if places > MOST_PLACES:
        return postings.repartitionByRange("field", "term", "doc_id")
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-(total or 0) // POSTINGS_PER_FILE))
    share = max(1, (total or 0) / parts)
    # At most MOST_PLACES rows.
    before = W.orderBy("field", "lead").rowsBetween(W.unboundedPreceding, -1)
    first = F.least(F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / share), F.lit(parts - 1))
    bounds = weights.select(
        F.col("field").alias("_field"), F.col("lead").alias("_lead"), first.alias("_first"),
        F.ceil(F.col("rows") / share).alias("_several"),
    )
    spread = F.pmod(F.xxhash64("term", "doc_id"), F.col("_several"))
    anywhere = F.pmod(F.xxhash64("field", "term"), F.lit(parts))
    part = F.coalesce(F.least(F.col("_first") + spread, F.lit(parts - 1)), anywhere).cast("int")
    same = (F.col("field") == F.col("_field")) & (F.substring("term", 1, LEAD) == F.col("_lead"))
    return postings.join(F.broadcast(bounds), same, "left").select(
        *postings.columns, part.alias("_part")
    ).repartitionById(parts, "_part").drop("_part")


def save_index(
    index: Index, path: str, appending: bool = False, deleted: DataFrame | None = None
) -> None:
    """Write the tables of an index as one batch.

    Postings are dealt out by ranges of (field, term) and sorted by term: a lookup reads the few
    row groups whose bounds hold the term, and a term that occurs in a third of all
    documents spreads over many files. They are computed once, on their way to the files.

    Without ``appending`` the batch starts a new generation and the older ones are removed
    once it is complete; ``index`` may well be read from ``path`` itself.
    """
    spark = index.docs.sparkSession
    before = _batches(spark, path)
    current = read_index(spark, path) if before and deleted is not None else None
    batch = uuid.uuid4().hex
    generation = before[0]["generation"] + (0 if appending else 1) if before else 0
    number = before[-1]["number"] + 1 if before and appending else 0

    def write(table: DataFrame, name: str) -> int:
        """Write one table of the batch and return its number of rows."""
        rows = Observation()
        (
            table.observe(rows, F.count(F.lit(1)).alias("rows"))
            .write.partitionBy(*(["doc_bucket"] if name == "docs" else []))
            .parquet(f"{path}/{name}/batch={batch}")
        )
        return rows.get["rows"]

    # Terms first: nearly all postings have one field, which would tell none of them apart.
    order = ["term", "field", "doc_id"]
    known = read_index(spark, path).terms if before and appending else None
    sample = sampled(index.postings) if index.sample is None else index.sample
    write(_dealt(index.postings, sample, known).sortWithinPartitions(*order), "postings")
    counts = term_dictionary(
        spark.read.schema(POSTINGS_SCHEMA).parquet(f"{path}/postings/batch={batch}")
    )
    removed = 0
    if deleted is not None:
        removed = write(deleted.select("doc_id").distinct(), "deleted")
        gone = spark.read.schema(DELETED_SCHEMA).parquet(f"{path}/deleted/batch={batch}")
        lost = current.postings.join(gone, "doc_id", "left_semi").groupBy("field", "term").agg(
            (-F.count(F.lit(1))).alias("df")
        )
        counts = counts.unionByName(lost).groupBy("field", "term").agg(F.sum("df").alias("df"))
    write(counts.sortWithinPartitions("field", "term"), "terms")
    n_docs = write(
        index.docs.repartition("doc_bucket").sortWithinPartitions("doc_bucket", "doc_id"), "docs"
    )
    row = (
        generation, number, batch, n_docs - removed, index.buckets,
        fields_to_json(index.fields), deleted is not None,
    )
    spark.createDataFrame([row], CORPUS_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{path}/corpus"
    )
    if not appending:
        for old in before:
            for name in TABLES:
                remove_path(spark, f"{path}/{name}/batch={old['batch']}")


def _docs_schema(fields: tuple[IndexField, ...]) -> str:
    kept = [f"`{field.name}` {field.data_type.simpleString()}" for field in doc_fields(fields)]
    return ", ".join(["doc_id bigint", *kept, "doc_bucket int"])


def read_index(
    spark: SparkSession, path: str, fields: list[IndexField] | None = None
) -> Index:
    """The index under ``path``; an empty one where there is none."""
    batches = _batches(spark, path)
    if not batches:
        known = tuple(fields or ())
        empty = spark.createDataFrame([], "doc_bucket int, doc_id bigint")
        for field in known:
            empty = empty.withColumn(field.name, F.lit(None).cast(field.data_type))
        return Index(
            fields=known,
            docs=empty,
            postings=spark.createDataFrame([], POSTINGS_SCHEMA),
            terms=spark.createDataFrame([], TERMS_SCHEMA),
            corpus=spark.createDataFrame([], "n_docs bigint"),
            buckets=1,
        )
    fields = fields_from_json(batches[0]["fields"])

    def table(name: str, schema: str, chosen: list) -> DataFrame:
        """The rows of some batches: a list of folders, so nothing else is looked at."""
        return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(
            *[f"{path}/{name}/batch={row['batch']}" for row in chosen]
        ).drop("batch")

    def alive(name: str, schema: str) -> DataFrame:
        """Rows whose documents no later batch has deleted.

        Batches between two deletions share their fate, so there is one anti-join per
        write with deletions since the last merge.
        """
        whole, pending = None, []
        for row in batches:
            if row["deletes"]:
                if pending:
                    part = table(name, schema, pending)
                    whole = part if whole is None else whole.unionByName(part)
                    pending = []
                gone = table("deleted", DELETED_SCHEMA, [row]).select("doc_id")
                if whole is not None:
                    whole = whole.join(gone, "doc_id", "left_anti")
            pending.append(row)
        part = table(name, schema, pending)
        return part if whole is None else whole.unionByName(part)

    counts = [(row["n_docs"],) for row in batches]
    return Index(
        fields=fields,
        docs=alive("docs", _docs_schema(fields)),
        postings=alive("postings", POSTINGS_SCHEMA),
        terms=table("terms", TERMS_SCHEMA, batches),
        corpus=spark.createDataFrame(counts, "n_docs bigint"),
        buckets=batches[0]["buckets"],
    )


def fetch_document(index: Index, doc_id: int) -> DataFrame:
    """Stored fields of one document; only its bucket is read."""
    bucket = doc_bucket(F.lit(doc_id), index.buckets)
    found = index.docs.filter((F.col("doc_bucket") == bucket) & (F.col("doc_id") == doc_id))
    return found.select("doc_id", *index.stored_names())
