"""Streams whose state ends by itself: event-time timers on state kept for each key.

State lives in the RocksDB store, so it may be larger than memory, and is checkpointed with the query. A key's timer
stands at the time when its state stops to matter; once the watermark has passed it, the state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lakeline.streaming.jobs import timed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86400


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Timed(StatefulProcessor):
    """One value for each key with one timer, in seconds of event time."""

    SCHEMA = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.SCHEMA)

    def keep(self, value: tuple, ends: int) -> None:
        """Store a value that still counts at the second ``ends``; its earlier timer goes."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update(value)
        self.handle.registerTimer(ends * 1000 + 1)

    def close(self) -> None:
        pass


class Lookups(Timed):
    """Hits and misses of a cache whose entries end ``sliding`` seconds after their last use or ``absolute`` after they
    were loaded. Lookups of a key within a batch are taken in the order of time."""

    SCHEMA = "loaded long, last long"

    def __init__(self, sliding: int, absolute: int) -> None:
        self.sliding, self.absolute = sliding, absolute

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        loaded, last = self.state.get() if self.state.exists() else (None, None)
        hits = misses = 0
        for t in sorted(t for part in rows for t in part["at"].tolist()):
            if loaded is not None and t - last < self.sliding and t - loaded < self.absolute:
                hits += 1
            else:
                misses, loaded = misses + 1, t
            last = t
        self.keep((loaded, last), min(last + self.sliding, loaded + self.absolute))
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "misses": [misses]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def lookup_hits(lookups: DataFrame, sliding: int = 1800, absolute: int = 7200, late: str = "0 seconds") -> DataFrame:
    """``key, hits, misses`` of each batch of a stream of lookups ``(key, ts)``; the sums are those of
    ``cache.lookup_stats`` over lookups that arrive in order to within ``late``. Later ones are dropped."""
    use_rocksdb(lookups.sparkSession)
    x = timed(lookups, late).withColumn("at", F.unix_timestamp("ts"))
    return x.groupBy("key").transformWithStateInPandas(Lookups(sliding, absolute), "key string, hits long, misses long", "Update", "EventTime")


class Entries(Timed):
    """Cache entries that end ``ttl`` seconds after they were made or last hit, whichever is later."""

    SCHEMA = "created long, last_hit long"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        created, last = self.state.get() if self.state.exists() else (None, None)
        for t, kind in sorted((t, k) for part in rows for t, k in zip(part["at"].tolist(), part["kind"])):
            if kind == "create":
                created, last = t, None
            elif created is not None:  # a hit of an entry that isn't there changes nothing
                last = t if last is None else max(last, t)
        if created is not None:
            self.keep((created, last), max(created, last or 0) + self.ttl)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"cache_id": [key[0]], "created": [created], "last_hit": pd.array([last], dtype="Int64")})


def expired_entries(events: DataFrame, days: int = 30, late: str = "0 seconds") -> DataFrame:
    """``cache_id, created, last_hit`` of each entry as it expires, from a stream ``(cache_id, ts, kind)`` of its creation
    (``create``; a second one renews it) and hits (``hit``). What has not expired at the watermark is what
    ``cache.cache_expire`` keeps at that time."""
    use_rocksdb(events.sparkSession)
    x = timed(events, late).withColumn("at", F.unix_timestamp("ts"))
    return x.groupBy("cache_id").transformWithStateInPandas(Entries(days * DAY), "cache_id long, created long, last_hit long", "Append", "EventTime")
