"""Answers that were shown and clicks on them as one stream: keyed state in event time, on the RocksDB store.

A row is a showing (kind 0) or a click (kind 1) of an answer. Rows wait in their key's state until the watermark has
passed them, and are then taken in the order of their times, so that a click meets the showings before it in whatever
order they arrived. A showing is forgotten `ttl` seconds after it by a timer in event time; a key with nothing left
holds no state. Spark's own time to live counts by the clock of the machines, which a replay of old events would not
survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "key long, kind int, interp_id string, facet string, ts timestamp"
CLICKS = "key long, interp_id string, ts timestamp, facet string, known boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ShownAnswers(StatefulProcessor):
    """Clicks with the facet of the last showing within `ttl` seconds; `known` is false where there is none."""

    def __init__(self, ttl: int) -> None:
        self.ttl = 1_000_000 * ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "kinds array<int>, names array<string>, facets array<string>, at array<long>")
        self.shown = handle.getMapState("shown", "interp_id string", "facet string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = None
        for chunk in rows:
            at = micros(chunk["ts"])
            facets = [f if isinstance(f, str) else None for f in chunk["facet"]]
            self.waiting.appendValue((chunk["kind"].tolist(), chunk["interp_id"].tolist(), facets, at))  # every call is a message to Spark
            latest = max(at) if latest is None else max(latest, max(at))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        ready, later = [], []
        for part in self.waiting.get() if self.waiting.exists() else ():
            for row in zip(*part, strict=True):
                (ready if row[3] <= now else later).append(row)
        ready.sort(key=lambda r: (r[3], r[0], r[1], r[2] or ""))
        # the showings of a key are read once and written as they are in the end
        stored = {name: tuple(last) for (name,), last in self.shown.iterator()} if self.shown.exists() else {}
        shown, clicks, due = dict(stored), set(), None
        for kind, name, facet, at in ready:
            if kind == 0:
                shown[name] = (facet, at)
                due = at + self.ttl
                continue
            last = shown.get(name)
            known = last is not None and at - last[1] < self.ttl
            clicks.add((at, name, last[0] if known else None, known))
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))
        if later:
            self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
        elif ready:
            self.waiting.clear()
        for name, last in shown.items():
            if now - last[1] < self.ttl:
                if stored.get(name) != last:
                    self.shown.updateValue((name,), last)
            elif name in stored:
                self.shown.removeKey((name,))
        if clicks:
            at, names, facets, known = zip(*sorted(clicks, key=lambda c: c[:2]), strict=True)
            yield pd.DataFrame({"key": [key[0]] * len(at), "interp_id": names, "ts": pd.to_datetime(at, unit="us"), "facet": pd.Series(facets, dtype=object), "known": known})

    def close(self) -> None:
        pass


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def clicked(rows: DataFrame, ttl: int = 86400, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, kind, interp_id, facet, ts) as the distinct clicks (key, interp_id, ts, facet, known).

    Rows without a key are passed over; rows that come later than `late` are dropped by the watermark. The session's
    state store must be RocksDB (`on_rocksdb`).
    """
    held = rows.where("key is not null").withWatermark("ts", late).groupBy("key")
    return held.transformWithStateInPandas(statefulProcessor=ShownAnswers(ttl), outputStructType=CLICKS, outputMode="Append", timeMode="EventTime")


def on_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
