"""Links of an endless crawl, united in keyed state that ends.

Each link (name, url) has its distinct paths in a map of the state store, one entry per path, and the time of its last crawl. A timer
clears a link that was not met for ``keep`` after that, so the state holds what is crawled now and not what ever was.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Workers get the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CRAWL_DDL = "name string, url string, path string, crawled_at timestamp"
CHANGES = ["name", "url", "path", "change", "at"]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _combined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each path of a link once per Arrow batch, so that a link met by a third of all rows sends few of them to its task."""
    for rows in batches:
        groups = rows.groupby(["name", "url", "path"], dropna=False, sort=False, as_index=False)
        yield groups.agg(first=("at", "min"), last=("at", "max"))


class _Links(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "first long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        latest, met = before, {}
        for batch in rows:
            for path, first, last in zip(batch["path"], batch["first"], batch["last"], strict=True):
                latest = int(last) if latest is None else max(latest, int(last))
                if not pd.isna(path):
                    met[path] = min(int(first), met.get(path, int(first)))
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.keep)
            self.handle.registerTimer(latest + self.keep)
            self.last.update((latest,))
        new = [(path, first) for path, first in met.items() if not self.paths.containsKey((path,))]
        for path, first in new:
            self.paths.updateValue((path,), (first,))
        yield pd.DataFrame([(*key, path, "new", first) for path, first in new], columns=CHANGES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.paths.clear()
        self.last.clear()
        yield pd.DataFrame([(*key, None, "expired", expiredTimerInfo.getExpiryTimeInMs())], columns=CHANGES)

    def close(self) -> None:
        pass


def link_changes(crawl: DataFrame, late_hours: int, keep_hours: int) -> DataFrame:
    """What a stream of (name, url, path, crawled_at) says that was not known: name, url, path, change, at.

    ``new`` is a path that its link did not have, with the time of its first row in the micro-batch; ``expired`` is a link, without
    path, that was not crawled for ``keep_hours`` after its last crawl. A link met again later starts anew. A row without path counts
    as a crawl of its link; absent names and urls are one name and url. Rows without time belong to no crawl and are left out. Rows may come in any
    order within ``late_hours`` of the newest one; a later row is not united, since its link may have expired: Spark counts it
    (``numRowsDroppedByWatermark``), and `incremental.united_links` over the stored crawl rows still has it. So ``late_hours`` is
    to be the longest time that a crawl may take. Needs the RocksDB state store, see `start_link_changes`.
    """
    timed = crawl.where("crawled_at is not null").select("name", "url", "path", F.unix_millis("crawled_at").alias("at"))
    combined = timed.mapInPandas(_combined, "name string, url string, path string, first long, last long")
    marked = combined.withColumn("crawled_at", F.timestamp_millis("last")).withWatermark("crawled_at", f"{late_hours} hours")
    changed = marked.groupBy("name", "url").transformWithStateInPandas(
        _Links(keep_hours * 3_600_000), "name string, url string, path string, change string, at long", "Append", "EventTime"
    )
    return changed.withColumn("at", F.timestamp_millis("at"))


def start_link_changes(crawl: DataFrame, folder: str, checkpoint: str, late_hours: int, keep_hours: int, available_now: bool = True) -> StreamingQuery:
    """Write `link_changes` as Parquet, each change exactly once; the query keeps its state in RocksDB, the session its own setting."""
    conf = crawl.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        writer = link_changes(crawl, late_hours, keep_hours).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start(folder)
    finally:
        conf.set(_STORE, before)
