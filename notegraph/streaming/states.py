"""The state of each page in a stream: what is new, edited or gone, by content, with deletions that wait for their file to come back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import delete
from ..sources import notes
from . import upkeep

EVENTS = "path string, event string, version long, text string, mtime timestamp, length long, hash string"
#: Spark keeps such state in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageStates(StatefulProcessor):
    """Keyed by path. A page's state is its hash, its version, and since when it has been gone (0: it is there).

    new: a path without state. edited: another hash than the state's; the same hash is no event, so a file that is only touched,
    or moved away and back, changes nothing. deleted: after a page has been gone for `grace` milliseconds, told by a timer; its state
    goes with it, so that state doesn't grow by pages of the past. With a grace of 0 it is deleted at once.
    """

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "hash string, version long, gone long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row = None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if row is None or (r.text is not None and (row.text is None or r.mtime >= row.mtime)):
                    row = r
        hash_, version, gone = self.page.get() if self.page.exists() else (None, 0, 0)
        now = timerValues.getCurrentProcessingTimeInMs()
        if row.text is None:
            if not version or gone:
                return
            if self.grace:
                self.page.update((hash_, version, now))
                self.handle.registerTimer(now + self.grace)
            else:
                self.page.clear()
                yield _event(key[0], "deleted", version)
            return
        if gone:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if hash_ == row.hash:
            if gone:
                self.page.update((hash_, version, 0))
            return
        self.page.update((row.hash, version + 1, 0))
        yield _event(key[0], "edited" if version else "new", version + 1, row.text, row.mtime, row.length, row.hash)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.page.exists():
            _, version, gone = self.page.get()
            if gone:
                self.page.clear()
                yield _event(key[0], "deleted", version)

    def close(self) -> None:
        pass


def _event(path, event, version, text=None, mtime=None, length=None, hash_=None) -> pd.DataFrame:
    out = pd.DataFrame({"path": [path], "event": [event], "version": [version], "text": [text], "mtime": [mtime], "length": [length], "hash": [hash_]})
    return out.astype({"version": "int64", "length": "Int64", "mtime": "datetime64[ns]"})


def page_events(changes: DataFrame, grace: int = 60_000) -> DataFrame:
    """EVENTS of a stream (path, text, mtime, length, hash), null texts for pages that are gone. The session needs STORE as its state store.

    A path should have one row in a micro-batch; of several, the newest text counts, and a deletion only without one.
    """
    return changes.groupBy("path").transformWithStateInPandas(PageStates(grace), EVENTS, "Update", "ProcessingTime")


def follow(spark: SparkSession, wiki: str, folder: str, grace: int = 60_000, **trigger):
    """A running query that keeps the tables of `upkeep` below folder up to a vault; trigger as of writeStream, such as processingTime='10 seconds'.

    Listings, checkpoint and tables lie below folder. A micro-batch that is run again after a failure brings the tables to the same rows.
    """
    notes.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    changes = spark.readStream.format("notes").option("path", wiki).option("listings", f"{folder}/listings").load()

    def step(events: DataFrame, n: int) -> None:
        path = f"{folder}/batches/{n}"  # a stream's own session plans without what it learns at run time, so the tables are made in the caller's
        events.select("path", "text", "mtime", "length").write.mode("overwrite").parquet(path)
        upkeep.apply(upkeep.State(spark, f"{folder}/tables"), spark.read.schema("path string, text string, mtime timestamp, length long").parquet(path))
        delete(spark, path)

    out = page_events(changes, grace).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    return (out.trigger(**trigger) if trigger else out).start()
