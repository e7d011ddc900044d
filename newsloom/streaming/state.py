"""Keyed state of streams: counters of discovered media, and a memory of links that forgets after some days.

Both are processors of transformWithState over the RocksDB store: state is kept by key in the checkpoint, a
micro-batch touches only the keys that it has, and gives out only what changed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.functions.urls import normalize_url
from newsloom.operators.state import EXAMPLES, KEEP_DAYS

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DISCOVERED = "domain string, publisher string, count long, first_seen string, last_seen string, examples array<string>"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start within keep state by key, which the store that Spark has by default can't."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Media(StatefulProcessor):
    """Per domain: how often it was found, first and last when, and the latest titles."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "publisher string, count long, first_seen string, last_seen string, examples array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        publisher, count, first, last, examples = self.entry.get() if self.entry.exists() else (None, 0, None, None, [])
        latest: list[tuple] = []
        earliest = None
        for part in rows:  # a key's rows come in parts of a bounded size, in any order
            count += len(part)
            part = part.sort_values("ord")
            head = part.iloc[0]
            earliest = min(filter(None, (earliest, (int(head["ord"]), head["publisher"], head["day"]))))
            latest = sorted(latest + [(int(o), t, d) for o, t, d in zip(part["ord"][-EXAMPLES:], part["title"][-EXAMPLES:], part["day"][-EXAMPLES:], strict=True)])[-EXAMPLES:]
        if publisher is None:
            publisher, first = earliest[1:]
        last, examples = latest[-1][2], [t for _, t, _ in reversed(latest)] + list(examples)
        self.entry.update((publisher, count, first, last, examples[:EXAMPLES]))
        yield pd.DataFrame({"domain": [key[0]], "publisher": [publisher], "count": [count], "first_seen": [first], "last_seen": [last], "examples": [examples[:EXAMPLES]]})

    def close(self) -> None:
        pass


def discovered_media(found: DataFrame) -> DataFrame:
    """DISCOVERED rows of a stream of found records (domain, source, via, title, selected_at, ord), for update mode: those that changed."""
    publisher = F.when(F.col("via") == "Googleニュース", F.col("source")).otherwise(F.col("domain"))
    rows = found.select("domain", publisher.alias("publisher"), "title", F.date_format("selected_at", "yyyy-MM-dd").alias("day"), F.col("ord").cast("long").alias("ord"))
    return rows.groupBy("domain").transformWithStateInPandas(_Media(), DISCOVERED, "update", "None")


def memory(days: int) -> type[StatefulProcessor]:
    class Memory(StatefulProcessor):
        """Per link: given out once, and forgotten when the watermark is so many days beyond."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.seen = handle, handle.getValueState("seen", "at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for part in rows:
                mine = part.sort_values(["published", "link"]).iloc[[0]]
                first = mine if first is None or mine["published"].iloc[0] < first["published"].iloc[0] else first
            if not self.seen.exists():
                at = int(first["published"].iloc[0].timestamp() * 1000)
                self.seen.update((at,))
                self.handle.registerTimer(at + days * 86_400_000)
                yield first[["link", "published"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.seen.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Memory


def remembered(items: DataFrame, days: int = KEEP_DAYS, late: dt.timedelta = dt.timedelta(0)) -> DataFrame:
    """(link, published) of a stream of items: each normalised link at most once in so many days, in append mode."""
    keyed = items.select("link", "published", normalize_url("link").alias("url")).withWatermark("published", f"{int(late.total_seconds())} seconds")
    return keyed.groupBy("url").transformWithStateInPandas(memory(days)(), "link string, published timestamp", "append", "EventTime")
