"""Pages that arrive over time: incremental scraping and recrawl suppression."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagelake.functions.times import RECRAWL_WINDOW_MINUTES
from pagelake.operators.ordering import sorted_blocks
from pagelake.operators.scrape import scrape
from pagelake.session import written
from pagelake.sources.store import PARTITIONS

# Workers get these functions with their tasks and need no package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Parquet files under ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def scrape_stream(
    pages: DataFrame, columns: Mapping[str, Column], path: str, checkpoint: str
) -> StreamingQuery:
    """Scrape arriving pages into the result store; the same projection as in batch.

    Takes what is there and stops; run it again for what arrived since. The checkpoint
    makes each page scraped exactly once.
    """
    return (
        scrape(pages, columns)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*PARTITIONS)
        .trigger(availableNow=True)
        .start()
    )


REQUEST_KEY = ["crawl_tag", "uri"]

#: Requests of one page from which they are gone through range by range, all at once.
HOT_ROWS = 100_000


def _passing(at: np.ndarray, last: int | None, span: int) -> np.ndarray:
    """Places of the requests that pass, of instants in order; one step for each of them."""
    found = []
    place = 0 if last is None else int(np.searchsorted(at, last + span))
    while place < len(at):
        found.append(place)
        place = int(np.searchsorted(at, at[place] + span))
    return np.array(found, np.int64)


def _exits(at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """What a range of instants does to the last accepted one before it.

    (upto, exit): if the earliest instant that may pass is at most ``upto``, and above the
    ``upto`` before, the last instant accepted in the range is ``exit``. Above them all
    nothing in the range is accepted.
    """
    # Whatever was accepted before the range, all that matters begins within one span.
    first = int(np.searchsorted(at, at[0] + span, side="right"))
    starts = np.unique(at[:first + 1], return_index=True)[1]
    ends, upto = starts.copy(), at[starts]
    following = np.append(np.searchsorted(at, at + span), len(at))
    while True:
        further = following[ends]
        going = further < len(at)
        if not going.any():
            break
        ends = np.where(going, further, ends)
    exits = at[ends]
    last_of_run = np.append(exits[1:] != exits[:-1], True)
    return upto[last_of_run], exits[last_of_run]


def _joined_latest(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """``requests`` with ``_instant`` and the instant last accepted for them before, ``_latest``."""
    latest = accepted.groupBy(*REQUEST_KEY).agg(F.max("crawled_at").alias("_latest"))
    same = reduce(and_, [F.col(f"r.{n}").eqNullSafe(F.col(f"l.{n}")) for n in REQUEST_KEY])
    return requests.alias("r").join(latest.alias("l"), same, "left").select(
        "r.*", F.unix_micros("l._latest").alias("_latest")
    ).withColumn("_instant", F.unix_micros("crawled_at")).filter("_instant IS NOT NULL")


def accepted_requests(
    requests: DataFrame, accepted: DataFrame, minutes: int = RECRAWL_WINDOW_MINUTES,
    tie: str = "doc_id",
) -> DataFrame:
    """The requests that may pass, going through them in the order of their instants.

    A request passes if no request for the same page and tag was ``accepted`` (crawl_tag,
    uri, crawled_at) less than ``minutes`` before it; then it is accepted itself and counts
    for the ones after it. One that is older than an accepted one does not pass either. Of
    requests at the same instant the smallest ``tie`` goes first. Requests without an
    instant do not pass.

    Pages with few requests are gone through one by one. Requests of a page with many are
    cut into ranges of time: each range tells what it makes of any last accepted instant
    before it, these are chained, and then all ranges are gone through at once.
    """
    span = minutes * 60_000_000
    marked = written(_joined_latest(requests, accepted), "requests")
    group = marked.withColumn("_group", F.struct(*REQUEST_KEY))
    hot = written(
        group.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= HOT_ROWS).select("_group"),
        "hot-pages",
    )
    columns = requests.columns
    few = _walked(group.join(hot, "_group", "left_anti"), requests.schema, span, tie)
    if hot.isEmpty():
        return few
    blocks = sorted_blocks(group.join(hot, "_group"), "_group", ["_instant", tie])

    def summary(batch: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(batch["_instant"].to_numpy(np.int64))
        upto, exits = _exits(at, span)
        return pd.DataFrame({
            "crawl_tag": batch["crawl_tag"].iloc[0], "uri": batch["uri"].iloc[0],
            "_block": batch["_block"].iloc[0], "_latest": batch["_latest"].iloc[0],
            "upto": upto, "exit": exits,
        })

    def chain(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values(["_block", "upto"])
        latest = ranges["_latest"].iloc[0]
        last, rows = None if pd.isna(latest) else int(latest), []
        for block, found in ranges.groupby("_block", sort=True):
            rows.append((ranges["crawl_tag"].iloc[0], ranges["uri"].iloc[0], block, last))
            earliest = found["upto"].iloc[0] if last is None else last + span
            place = int(np.searchsorted(found["upto"].to_numpy(), earliest))
            if place < len(found):
                last = int(found["exit"].iloc[place])
        return pd.DataFrame(rows, columns=["crawl_tag", "uri", "_block", "_entry"]).astype(
            {"_entry": "Int64"}
        )

    def accept(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_instant", tie])
        entry = batch["_entry"].iloc[0]
        at = batch["_instant"].to_numpy(np.int64)
        chosen = _passing(at, None if pd.isna(entry) else int(entry), span)
        return batch.iloc[chosen][columns]

    of_range = [*REQUEST_KEY, "_block"]
    key = ", ".join(
        f"{name} {requests.schema[name].dataType.simpleString()}" for name in REQUEST_KEY
    )
    ranges = blocks.select(*of_range, "_instant", "_latest").groupBy(*of_range).applyInPandas(
        summary, f"{key}, _block int, _latest bigint, upto bigint, exit bigint"
    )
    entries = ranges.groupBy(*REQUEST_KEY).applyInPandas(chain, f"{key}, _block int, _entry bigint")
    renamed = entries.toDF("_tag", "_uri", "_of", "_entry")
    same = (
        F.col("crawl_tag").eqNullSafe(F.col("_tag")) & F.col("uri").eqNullSafe(F.col("_uri"))
        & (F.col("_block") == F.col("_of"))
    )
    many = blocks.join(renamed, same).select(*columns, "_block", "_instant", "_entry").groupBy(
        *of_range
    ).applyInPandas(accept, requests.schema)
    return few.unionByName(many)


def _walked(marked: DataFrame, schema: T.StructType, span: int, tie: str) -> DataFrame:
    """Requests that pass, page by page: rows are sorted by Spark and go by in order."""
    columns = schema.names

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = object(), None
        for batch in batches:
            passes = []
            rows = zip(batch[REQUEST_KEY[0]], batch[REQUEST_KEY[1]], batch["_instant"], batch["_latest"])
            for tag, uri, at, latest_at in rows:
                if (tag, uri) != key:
                    key = (tag, uri)
                    last = None if pd.isna(latest_at) else int(latest_at)
                new = last is None or at - last >= span
                if new:
                    last = int(at)
                passes.append(new)
            yield batch.loc[passes, columns]

    ordered = marked.drop("_group").repartition(*REQUEST_KEY).sortWithinPartitions(
        *REQUEST_KEY, "crawled_at", tie
    )
    return ordered.mapInPandas(walk, schema)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Pages and tags share a row of state by a hash, as a call for each of them costs more than
#: its requests do.
STATE_GROUPS = 1024
_GROUP = "_state_group"


def _keyed_state(schema: T.StructType, span: int, tie: str, expires: bool):
    """The processor that keeps the last accepted instant of each page and tag of a group."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    columns = schema.names
    tag, uri = (schema[name].dataType.simpleString() for name in REQUEST_KEY)
    state = f"tags array<{tag}>, uris array<{uri}>, at array<bigint>"

    class LastAccepted(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", state)

        def handleInputRows(self, key, rows, timerValues):
            batches = list(rows)
            arrived = batches[0] if len(batches) == 1 else pd.concat(batches)
            arrived = arrived.reset_index(drop=True)
            instants = arrived["crawled_at"].to_numpy("datetime64[us]")
            # Sorted by instant and tie; those without an instant come last.
            order = np.argsort(arrived[tie].to_numpy(), kind="stable")
            order = order[np.argsort(instants[order], kind="stable")]
            order = order[:len(order) - int(np.isnat(instants).sum())]
            if not len(order):
                return
            # Then by page and tag, of which any may be null.
            of = arrived.groupby(REQUEST_KEY, sort=False, dropna=False).ngroup().to_numpy()
            order = order[np.argsort(of[order], kind="stable")]
            at, of = instants[order].astype(np.int64), of[order]
            stored = self.last.get()
            known = {} if stored is None else dict(zip(zip(stored[0], stored[1]), stored[2]))
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            names = arrived[REQUEST_KEY].iloc[order[starts]].astype(object)
            names = names.where(names.notna(), None).itertuples(index=False, name=None)
            found = []
            for name, first, end in zip(names, starts, np.append(starts[1:], len(order))):
                chosen = first + _passing(at[first:end], known.get(name), span)
                if len(chosen):
                    known[name] = int(at[chosen[-1]])
                    found.append(chosen)
            if not found:
                return
            if expires:
                # Nothing older than the watermark comes any more.
                passed = timerValues.getCurrentWatermarkInMs() * 1000 - span
                known = {name: last for name, last in known.items() if last >= passed}
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                if known:
                    self.handle.registerTimer((max(known.values()) + span) // 1000 + 1)
            self.last.update((
                [tag for tag, _ in known], [uri for _, uri in known], list(known.values())
            ))
            yield arrived.iloc[order[np.concatenate(found)]][columns]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # Nothing older than the watermark comes any more, so nothing is held back.
            self.last.clear()
            return iter(())

        def close(self):
            pass

    return LastAccepted()


def suppress_recrawls(
    requests: DataFrame, path: str, checkpoint: str, minutes: int = RECRAWL_WINDOW_MINUTES,
    tie: str = "doc_id", lateness: str | None = None,
) -> StreamingQuery:
    """Write the arriving requests that may pass to ``path``, each exactly once.

    The last accepted instant of each page and tag is keyed state, so a batch reads nothing
    of what was written before. A batch's requests are gone through in the order of their
    instants; one older than an accepted one does not pass, nor does one without an instant.

    Without ``lateness`` requests may come in any order and the state is kept. With it (such
    as ``"2 hours"``) requests that lie further than that behind the newest one seen in
    earlier batches are dropped, and the state of a page expires by a timer once nothing
    can come that it would hold back.
    """
    spark = requests.sparkSession
    arriving = requests if lateness is None else requests.withWatermark("crawled_at", lateness)
    group = F.pmod(F.xxhash64(*REQUEST_KEY), F.lit(STATE_GROUPS)).cast("int")
    found = arriving.withColumn(_GROUP, group).groupBy(_GROUP).transformWithStateInPandas(
        _keyed_state(requests.schema, minutes * 60_000_000, tie, lateness is not None),
        outputStructType=requests.schema, outputMode="Append",
        timeMode="None" if lateness is None else "EventTime",
    )
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            found.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
