"""Stored profiles and the state that runs carry on: read with a default, written beside and then named.

State is versioned: a run writes a new folder and then adds a marker with its name beside the earlier ones,
of which the newest counts. Nothing is ever overwritten, so a run that fails at any point leaves the state
before it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.config import Topic, topic_of

RECORDS = """title string, link string, source string, via string, collector string, feed_url string, domain string, lang string, score double,
    published timestamp, selected_at timestamp, topics array<struct<name: string, keywords: array<string>>>, `primary` string, related array<string>, place int"""
MARKER = "at long, version string"
DISCOVERED = "domain string, publisher string, count long, first_seen string, last_seen string, examples array<string>"


@dataclass
class Profile:
    topics: list[Topic]
    vetoes: list[Topic]
    weights: dict[str, float]
    allocation: dict[str, float]
    keyword_weights: dict[str, dict[str, float]]
    known_domains: list[str]
    known_publishers: list[str]
    sources: list[dict]


def profile_of(data: dict) -> Profile:
    topics = [(topic_of(d), d) for d in data["topics"]]
    return Profile(
        topics=[t for t, _ in topics if t.collect],
        vetoes=[t for t, _ in topics if not t.collect],
        weights={t.name: d["weight"] for t, d in topics},
        allocation={t.name: d.get("allocation", 0.0) for t, d in topics if t.collect},
        keyword_weights={t.name: d.get("keyword_weights", {}) for t, d in topics},
        known_domains=list(data["known_domains"]),
        known_publishers=list(data.get("known_publishers", [])),
        sources=list(data.get("sources", [])),
    )


def read_profile(path: str) -> Profile:
    with open(path, encoding="utf-8") as f:
        return profile_of(json.load(f))


def _current(spark: SparkSession, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MARKER).json(f"{path}/markers").agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version, or an empty table if there is none yet."""
    version = _current(spark, path)
    return spark.read.schema(schema).json(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def write_state(spark: SparkSession, state: DataFrame, path: str) -> None:
    version = f"v-{uuid.uuid4().hex}"
    state.write.json(f"{path}/{version}")
    spark.createDataFrame([(time.time_ns(), version)], MARKER).coalesce(1).write.mode("append").json(f"{path}/markers")
