"""Keyed state: presence checks of readers, with event-time timers, and the latest result of each spot check.

Rows may come in any order within the watermark's delay. What a state does depends on event time only, so the order of
rows and their micro-batches change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.expr import near_ms
from lectern.operators import presence
from lectern.sources import tables
from lectern.streaming.readers import WATERMARK, settled, source

#: State with timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CHECK_MS, MISS_MS = int(presence.CHECK_S * 1000), int((presence.CHECK_S + presence.ANSWER_S) * 1000)


class PresenceChecks(StatefulProcessor):
    """A reader's signs of life wait in the state until the watermark has passed them; then they and the deadlines happen in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")
        self.present = handle.getValueState("present", "at long, told int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        found = [int(x) for batch in rows for x in batch["ms"] if x > now]
        if found:
            self.waiting.appendList([(x,) for x in found])
            self.handle.registerTimer(min(found))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        signs = sorted(x[0] for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in signs if x <= now], [x for x in signs if x > now]
        last, told = self.present.get() if self.present.exists() else (None, 0)
        out = []
        for sign in [*due, None]:
            until = now if sign is None else sign - 1
            for k, (wait, kind) in enumerate(((CHECK_MS, "raised"), (MISS_MS, "missed"))):
                if last is not None and told == k and last + wait <= until:
                    out.append((kind, last + wait))
                    told = k + 1
            if sign is not None:
                if told:
                    out.append(("cleared", sign))
                last, told = sign, 0
        if last is not None:
            self.present.update((last, told))
        if later:
            self.waiting.put([(x,) for x in later])
        else:
            self.waiting.clear()
        ahead = [x for x in (min(later, default=None), *(last + w for w in (CHECK_MS, MISS_MS)[told:])) if x is not None and x > now] if last is not None else later[:1]
        if ahead:
            self.handle.registerTimer(min(ahead))
        if out:
            yield pd.DataFrame({"reader": key[0], "kind": [k for k, _ in out], "ms": [x for _, x in out]})

    def close(self) -> None:
        pass


def checks(events: DataFrame) -> DataFrame:
    """``reader, kind, ms``: presence checks raised, missed and cleared, as far as the watermark has come; ``ms`` is the time of it."""
    rows = events.select("ts", F.col("user_id").alias("reader"), F.unix_millis("ts").alias("ms")).where("reader IS NOT NULL")
    return rows.groupBy("reader").transformWithStateInPandas(PresenceChecks(), "reader long, kind string, ms long", "Append", "EventTime")


def presence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(checks(source(spark, sf_dir).withWatermark("ts", WATERMARK)), "append", STORE)
    return out.select("reader", "kind", F.timestamp_millis("ms").cast("timestamp_ntz").alias("at"))


#: A window's results are compared within so long a stretch of event time; its state goes once the watermark has passed the stretch.
KEPT = "1 minute"


def latest(results: DataFrame) -> DataFrame:
    """``reader, doc_id, begin, to, blanks, recalled, ms, event_id`` in update mode: each window's latest result of a minute, each time that rows of it come.

    Rows of minutes that the watermark has passed change nothing. A window's latest result of all is the latest of its
    minutes'. The aggregate is native: a call of Python for each window took most of the time.
    """
    best = F.max_by(F.struct("begin", "blanks", "recalled", "ms", "event_id"), F.struct("ms", "event_id")).alias("r")
    by = results.groupBy(F.window("ts", KEPT), "reader", "doc_id", "to").agg(best)
    return by.select("reader", "doc_id", "r.begin", "to", "r.blanks", "r.recalled", "r.ms", "r.event_id")


def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest result of every window: what the stream said last of it."""
    stream = tables.as_check_results(source(spark, sf_dir)).withWatermark("ts", WATERMARK)
    return presence.latest_results(settled(latest(stream.withColumn("ms", near_ms(F.col("ts")))), "update"))
