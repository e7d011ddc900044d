"""Candidate items as a stream.

What a batch run does with files and state is done per micro-batch: items that are too late are dropped
by a watermark with the duplicates of what was seen within it, and each batch is handed to the same
ranking as a batch run. Counters per domain are kept natively, as an aggregation in update mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.urls import domain_of, normalize_url
from newsloom.operators.exclusion import MAX_AGE_HOURS


def fresh_once(items: DataFrame, hours: int = MAX_AGE_HOURS) -> DataFrame:
    """Items of a stream by normalised URL, each once, dropped if later than the watermark of `published`."""
    keyed = items.withColumn("url", normalize_url("link")).withWatermark("published", f"{hours} hours")
    return keyed.dropDuplicatesWithinWatermark(["url"]).drop("url")


def domain_counts(items: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, domain, n) of a stream of items."""
    rows = items.select("published", domain_of("link").alias("domain")).withWatermark("published", late)
    return rows.groupBy(F.window("published", window), "domain").agg(F.count("*").alias("n"))


def run_batches(items: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there, in micro-batches, through `handle` (for one, a ranking and its sinks)."""
    return items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
