"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, ASCII letters in lower case.
Keys are known by two 64-bit hashes. Documents arrive in batches. The state is a set of
*runs* of (hash, number of documents), all bucketed and sorted by hash alike, so that they
are merged bucket by bucket without being shuffled again. A run is either *settled* (its hashes have reached the limit and need no more counting) or belongs
to a level. Each new batch merge-anti-joins the settled runs, so that only hashes still
below the limit are counted further, and adds what remains as a run of level 0. When a
level holds ``FAN_IN`` runs they are compacted: merged by hash into one run of the next
level, while hashes that reach the limit move to a settled run. Hashes can be spread over
several levels until :meth:`LineRuns.frequent` merges the levels a last time.

The runs can be kept and take in the batches of later calls. Every run is written to the
shared folder, so a lost executor costs a task, not a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.tables import LOWER, UPPER, WHITE, SortedRuns, free_name, settle

#: Runs of one level that are compacted into one run of the next level.
FAN_IN = 3
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line trimmed of white space, A-Z in lower case; blank lines have an empty key."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _key_hashes(key: Column) -> Column:
    """Two independent hashes of a key: 128 bits, so that equal hashes mean equal keys."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _hashes(text: Column) -> Column:
    """The hashes of a text's distinct non-empty keys."""
    keys = F.filter(F.transform(lines_of(text), line_key), lambda key: key != "")
    return F.transform(F.array_distinct(keys), _key_hashes)


class LineRuns:
    """The levelled runs of line hashes seen so far, for a limit of ``min_docs`` documents.

    ``levels`` and ``settled`` hold the numbers of the runs in the tables ``open`` and
    ``done``.
    """

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.open = SortedRuns(spark, "line-runs", HASH, self.buckets)
        self.done = SortedRuns(spark, "line-settled", HASH, self.buckets)
        self.levels: list[list[int]] = []
        self.settled: list[int] = []

    def below(self, counts: DataFrame) -> DataFrame:
        """The rows whose hashes have not settled."""
        if not self.settled:
            return counts
        known = self.done.read(self.settled).select(*HASH).hint("merge")
        return counts.join(known, HASH, "left_anti")

    def add(self, counts: DataFrame, dealt: bool = False) -> None:
        """Take in one batch of (h1, h2, n), each hash once; ``dealt`` out like the runs."""
        if not dealt:
            counts = counts.repartition(self.buckets, *HASH)
        self._place(self.open.add(self.below(counts.select(*HASH, "n"))), 0)

    def _place(self, run: int, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            runs, self.levels[level] = self.levels[level], []
            counts = self.merged(runs)
            reached = F.col("n") >= self.min_docs
            rest = self.open.add(counts.where(~reached))
            self.settled.append(self.done.add(counts.where(reached)))
            self.open.remove(runs)
            self._place(rest, level + 1)

    def merged(self, runs: list[int]) -> DataFrame:
        """One row per hash of some runs; a hash settled meanwhile is in no level."""
        return self.below(self.open.read(runs).groupBy(*HASH).agg(F.sum("n").alias("n")))

    def frequent(self) -> DataFrame:
        """(h1, h2) of all keys found in at least ``min_docs`` documents."""
        open_runs = [run for level in self.levels for run in level]
        found = self.merged(open_runs).where(F.col("n") >= self.min_docs).select(*HASH)
        if self.settled:
            found = found.union(self.done.read(self.settled).select(*HASH))
        return settle(found, "line-frequent")

    def close(self) -> None:
        """Delete the runs."""
        self.open.close()
        self.done.close()
        self.settled, self.levels = [], []


def frequent_lines(
    docs: DataFrame, min_docs: int, *, text: str = "text", key: str = "doc_id", batches: int = 4,
    runs: LineRuns | None = None,
) -> DataFrame:
    """(h1, h2) of the keys in at least ``min_docs`` rows, gathered batch by batch.

    The rows are dealt to ``batches`` arrivals by a hash of their key; texts are read once.
    With ``runs``, rows that these have taken in before count as well, and these are kept.
    """
    kept = runs is not None
    runs = runs or LineRuns(docs.sparkSession, min_docs)
    batch = F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int")
    # One row per hash, with its number in each batch, dealt out by hash like the runs.
    numbers = [F.count_if(F.col("batch") == n).alias(f"n{n}") for n in range(batches)]
    hashed = docs.select(batch.alias("batch"), F.explode(_hashes(F.col(text))).alias("h"))
    arrived = SortedRuns(docs.sparkSession, "line-batches", HASH, runs.buckets)
    whole = arrived.add(hashed.select("batch", "h.*").groupBy(*HASH).agg(*numbers))
    for number in range(batches):
        own = arrived.read([whole]).where(F.col(f"n{number}") > 0)
        runs.add(own.select(*HASH, F.col(f"n{number}").alias("n")), dealt=True)
    frequent = runs.frequent()
    if not kept:
        runs.close()
    arrived.close()
    return frequent


def drop_frequent_lines(
    docs: DataFrame, min_docs: int, *, text: str = "text", key: str = "doc_id", batches: int = 4,
    runs: LineRuns | None = None,
) -> DataFrame:
    """The rows of ``docs`` with two more columns, ``line_kept`` and ``line_counts``.

    ``line_kept`` holds the lines that stay, joined by line feeds (an empty string if none
    stays); ``line_counts`` is a struct of ``n_lines`` before and ``n_dropped``. Names that
    ``docs`` already has get underscores in front.

    Null and empty texts are one empty line, which is kept. Blank lines have an empty key
    and always stay. Every row counts as one document, a repeated row as another one; a
    line repeated in one document counts once and goes everywhere. Null keys are rows like
    any other. An empty table gives an empty table. With ``runs`` the documents of earlier
    calls count as well.
    """
    frequent = frequent_lines(
        docs, min_docs, text=text, key=key, batches=batches, runs=runs
    )
    body = F.coalesce(F.col(text), F.lit(""))
    found = (
        docs.select(
            F.col(key).alias("id"), F.xxhash64(body).alias("version"),
            F.posexplode(lines_of(F.col(text))).alias("at", "line"),
        )
        .withColumn("line", line_key(F.col("line"))).where("line != ''")
        .select("id", "version", "at", _key_hashes(F.col("line")).alias("h"))
        .select("id", "version", "at", "h.*")
        .join(frequent, ["h1", "h2"])
        .groupBy("id", "version").agg(F.collect_set("at").alias("dropped"))
    )
    joined = docs.alias("d").join(
        found.alias("f"),
        F.col(f"d.{key}").eqNullSafe(F.col("f.id"))
        & (F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit(""))) == F.col("f.version")),
        "left",
    )
    own = F.coalesce(F.col(f"d.{text}"), F.lit(""))
    dropped = F.col("f.dropped")

    def without(lines: Column) -> Column:
        # array_except works with a hash set: linear in the lines, however many go.
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n")

    # The lines are the variable of an outer lambda, so that a text is split once. Texts
    # without a frequent line are not split at all.
    cut = F.transform(F.array(lines_of(own)), without)[0]
    kept = F.when(dropped.isNull(), own).otherwise(cut)
    feeds = F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit("")))
    counts = F.struct(
        (feeds + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    return joined.select(
        "d.*", kept.alias(free_name(docs, "line_kept")),
        counts.alias(free_name(docs, "line_counts")),
    )
