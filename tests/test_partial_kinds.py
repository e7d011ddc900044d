"""Partials of some kinds are those of all kinds, and texts aren't worked on for the others."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import story_tokens
from newsloom.plans import partials
from newsloom.sources.config import Topic

TOPICS = [Topic("a", ["red ring", "plate"], ["bolt"]), Topic("b", ["blue"], [], ["old"])]
ROWS = [(i, dt.date(2024, 1, 1 + i % 3), t) for i, t in enumerate(["A red ring", "blue plates", "old blue bolt", None, "", "red-ring plate red ring", "bolts"])] + [(9, None, "red ring")]


@pytest.mark.parametrize("kinds", [("topic",), ("keyword",), ("term",), ("topic", "term"), ("topic", "keyword")])
def test_kinds(spark, kinds):
    rows = spark.createDataFrame(ROWS, "id long, day date, text string")
    everything = partials.day_partials(spark, rows, TOPICS, story_tokens("text")).collect()
    some = partials.day_partials(spark, rows, TOPICS, story_tokens("text"), kinds).collect()
    wanted = [r for r in everything if r.kind in (*kinds, "all")]
    assert wanted and sorted(map(repr, some)) == sorted(map(repr, wanted))


def test_nothing_is_matched_for_terms_alone(spark, monkeypatch):
    def fails(*_):
        raise AssertionError("matched")

    monkeypatch.setattr(partials, "hits", fails)
    rows = spark.createDataFrame(ROWS, "id long, day date, text string")
    assert partials.day_partials(spark, rows, TOPICS, story_tokens("text"), ("term",)).where(F.col("kind") == "term").count() > 5
