"""A result cache for a stream of requests whose entries leave the state store when they expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siftmill.functions import text as tx

#: What a stream of events gives: the cached results of each request that found some, and null of each that did not.
ANSWERS = "id string, query string, at timestamp, results string, cached_at timestamp"
_ENTRY = "query string, results string, cached_at long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ForgettingCache(StatefulProcessor):
    """One entry a query: an event with results stores them, one without asks for them.

    An entry that is older than `ttl_seconds` is not found, and a timer on event time removes it from the store once the
    watermark has passed its end. With 0, entries stay. A later answer takes the place of an earlier one, and its end.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # The events of one query in one batch, few as a rule; they are taken in the order of their times, answers before questions.
        events = pd.concat(list(rows)).assign(asks=lambda d: d["results"].isna()).sort_values(["at", "asks"], kind="stable")
        out = []
        for e in events.itertuples(index=False):
            at = int(e.at.timestamp())
            held = self.entry.get() if self.entry.exists() else None
            if not e.asks:
                if held is None or at >= held[2]:
                    if held is not None and self.ttl:
                        self.handle.deleteTimer((held[2] + self.ttl) * 1000)
                    self.entry.update((e.query, e.results, at))
                    if self.ttl:
                        self.handle.registerTimer((at + self.ttl) * 1000)
                continue
            fresh = held is not None and held[2] <= at and (not self.ttl or at - held[2] <= self.ttl)
            out.append((key[0], e.query, e.at, held[1] if fresh else None, pd.Timestamp(held[2], unit="s") if fresh else pd.NaT))
        if out:
            yield pd.DataFrame(out, columns=["id", "query", "at", "results", "cached_at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and (self.entry.get()[2] + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_answers(events: DataFrame, ttl_seconds: int, delay: str = "10 seconds") -> DataFrame:
    """ANSWERS for a stream of events (query, at, results): an event with results stores them, one without asks for them.

    Entries are told apart by the same identifier as in the result cache. Events later than `delay` are dropped, as the
    watermark has passed them. The state store has to be RocksDB (`ROCKS`), which keeps the state on disk.
    """
    keyed = events.select(tx.uuid5(tx.CACHE_NAMESPACE, F.col("query")).alias("id"), "query", F.date_trunc("second", "at").alias("at"), "results")
    return keyed.withWatermark("at", delay).groupBy("id").transformWithStateInPandas(ForgettingCache(ttl_seconds), ANSWERS, "Append", "EventTime")
