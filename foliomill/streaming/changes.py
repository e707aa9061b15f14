"""Process new and changed files as listings arrive; what was seen is kept as state by path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliomill.plans.model import ModelSettings
from foliomill.plans.process import process_contents
from foliomill.session import scratch, written
from foliomill.sources.files import with_signature
from foliomill.sources.store import ProcessedStore
from foliomill.sources.tree import LISTING_SCHEMA, with_content

CHANGED_SCHEMA = "path string, signature string, change string"
# The state store that keyed state needs; and no batches without listings, as a query with
# expiry would otherwise ask for one after the other and never be drained.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def stream_inventory(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Listings (path, modificationTime, length) as a stream: each Parquet file put into ``folder`` is one."""
    source = spark.readStream.schema(LISTING_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(folder)


class Seen(StatefulProcessor):
    """Holds the signature and time of a path's newest listing and passes on those that differ."""

    def __init__(self, keep_ms: int | None) -> None:
        self._keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "signature string, modified long", self._keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        modified, signature = max((m, s) for part in rows for m, s in zip(part["modified"], part["signature"]))
        held = self._newest.get() if self._newest.exists() else None
        if held is None or (signature != held[0] and modified >= held[1]):
            self._newest.update((signature, int(modified)))
            change = "new" if held is None else "changed"
            yield pd.DataFrame({"path": [key[0]], "signature": [signature], "change": [change]})
        elif self._keep_ms is not None:
            self._newest.update((held[0], int(held[1])))  # listed again, so kept as long again

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._newest.update((str(initialState["signature"].iloc[0]), -1))

    def close(self) -> None:
        pass


def changed_files(listings: DataFrame, known: DataFrame | None = None, keep_days: int | None = None) -> DataFrame:
    """(path, signature, change) of listed files not seen before (``new``) or with another signature (``changed``).

    A path listed several times in a batch counts by its newest time; an older listing that comes late changes
    nothing. ``known`` (path, signature) are files seen before the stream's first batch; their times aren't known, so
    any other signature is a change. With ``keep_days`` a path not
    listed for so long is forgotten, and is new when it comes back. Listings without a path, a time or a length
    say nothing about a state and are left out. Rows meet by path; contents are never part of them.
    """
    signed = with_signature(listings.select("path", "modificationTime", "length")).filter("signature IS NOT NULL")
    rows = signed.select("path", "signature", F.unix_micros("modificationTime").alias("modified"))
    before = None
    if known is not None:
        known = known.filter("path IS NOT NULL AND signature IS NOT NULL")
        before = known.groupBy("path").agg(F.max("signature").alias("signature")).groupBy("path")
    keep_ms, time = (None, "None") if keep_days is None else (keep_days * 86_400_000, "ProcessingTime")
    return rows.groupBy("path").transformWithStateInPandas(Seen(keep_ms), CHANGED_SCHEMA, "Update", time, before)


def ingest_changes(
    listings: DataFrame,
    store: ProcessedStore,
    settings: ModelSettings,
    checkpoint: str,
    keep_days: int | None = None,
    **how,
) -> StreamingQuery:
    """Append new and changed files to the store, one version per batch with any, until the listings are drained.

    The store is read when a checkpoint is new, for what it holds already, and in the first batch after a
    start: that one may have been stored before the stream stopped. Later batches rely on the state alone.
    Files are read where their row lies; one that has gone meanwhile is stored as a failed extraction.
    """
    spark = store.spark
    known = store.states().select("path", "signature")
    first = True

    def batch(rows: DataFrame, _: int) -> None:
        nonlocal first
        todo = rows.select("path", "signature")
        if first:
            held = store.states().select("path", "signature")
            todo = todo.join(held, ["path", "signature"], "left_anti")
        with scratch():
            todo = written(todo, "changed")
            if not todo.isEmpty():
                contents = with_content(todo).withColumn("doc_type", F.lit(None).cast("string"))
                store.write(process_contents(contents, store, settings, **how), store.next_version())
        first = False

    before = {key: spark.conf.get(key) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():  # taken by the query when it starts
        spark.conf.set(key, value)
    try:
        return (
            changed_files(listings, known, keep_days)
            .writeStream.outputMode("update")
            .foreachBatch(batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
