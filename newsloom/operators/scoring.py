"""Relevance scores of candidates by the topics they hit."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.scores import missed, rounded
from newsloom.functions.text import text_of
from newsloom.functions.times import age_hours
from newsloom.operators.matching import hits, matched_keywords, term_table
from newsloom.sources.config import Topic

# The factors of a score.
HALF_LIFE_HOURS = 72.0
SUMMARY_FACTOR = 0.5
GOOGLE_FACTOR = 0.85
SPECIALIST_FACTOR = 1.5
SPECIALIST_BASE = 0.5
DEFAULT_TOPIC_WEIGHT = 0.5
GENERAL, AND_OTHERS = "全般", "ほか"


def is_specialist(source_topics: Column, topic: str) -> Column:
    """Whether the head of a source's topics names a part of the topic and isn't general."""
    head = F.element_at(F.split(text_of(source_topics), "[、,]", 2), 1)
    parts = set(re.findall(r"[^・（）()、\s]{2,}", topic)) - {AND_OTHERS}
    named = F.lit(False)
    for p in sorted(parts):
        named = named | head.contains(p)
    return (head != "") & ~head.contains(GENERAL) & named


def freshness(published: Column, via: Column, now: Column) -> Column:
    return F.pow(F.lit(0.5), age_hours(published, now) / HALF_LIFE_HOURS) * F.when(via == "Googleニュース", GOOGLE_FACTOR).otherwise(1.0)


def topic_scores(spark: SparkSession, items: DataFrame, topics: list[Topic], weights: dict[str, float], keyword_weights: dict[str, dict[str, float]]) -> DataFrame:
    """(ord, topic_ord, topic, keywords, title_relevance, relevance, weight, contribution) of each item's topics."""
    special = [F.when(is_specialist(F.col("source_topics"), t.name), F.struct(F.lit(i).alias("topic_ord"), F.lit(t.name).alias("topic"))) for i, t in enumerate(topics)]
    fields = F.explode(F.array(F.struct(F.lit(True).alias("in_title"), F.col("title").alias("text")), F.struct(F.lit(False).alias("in_title"), F.col("summary").alias("text"))))
    texts = items.select("ord", fields.alias("x")).select("ord", "x.in_title", "x.text")
    found = hits(texts, term_table(spark, topics, keyword_weights))
    specialists = items.select("ord", F.col("source").alias("special_source"), F.explode(F.filter(F.array(*special), lambda s: s.isNotNull())).alias("s")).select("ord", "s.topic_ord", "s.topic", "special_source")
    rows = found.unionByName(specialists, allowMissingColumns=True).groupBy("ord", "topic_ord", "topic")
    none = F.expr("cast(array() as array<struct<pos: int, keyword: string, weight: double>>)")
    both = rows.agg(
        F.coalesce(F.max(F.when(F.col("in_title"), F.col("hits"))), none).alias("titled"),
        F.coalesce(F.max(F.when(~F.col("in_title"), F.col("hits"))), none).alias("summed"),
        F.max("special_source").alias("special_source"),
    )
    both = both.withColumn("summed", F.filter("summed", lambda h: ~F.array_contains(matched_keywords("titled"), h["keyword"])))
    special_hit = F.col("special_source").isNotNull()
    base = F.when(special_hit & (F.size("titled") == 0), 1 - SPECIALIST_BASE).otherwise(1.0)
    title_left = base * missed(F.transform("titled", lambda h: h["weight"]))
    left = title_left * missed(F.transform("summed", lambda h: h["weight"] * SUMMARY_FACTOR))
    keywords = F.concat(matched_keywords("titled"), matched_keywords("summed"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ({"": 0.0} | weights).items() for x in kv]), F.col("topic")), F.lit(DEFAULT_TOPIC_WEIGHT))
    scored = both.select(
        "ord", "topic_ord", "topic",
        F.when(F.size(keywords) > 0, keywords).otherwise(F.array(F.concat(F.lit("専門媒体: "), F.col("special_source")))).alias("keywords"),
        (1 - title_left).alias("title_relevance"), (1 - left).alias("relevance"), weight.alias("weight"), special_hit.alias("special"),
    )
    return scored.withColumn("contribution", F.col("weight") * F.col("relevance") * F.when(F.col("special"), SPECIALIST_FACTOR).otherwise(1.0))


def with_scores(spark: SparkSession, items: DataFrame, topics: list[Topic], weights: dict[str, float], keyword_weights: dict[str, dict[str, float]], now: Column, round_score: Callable[[Column, int], Column] = rounded) -> DataFrame:
    """items with score, fresh, topics (by contribution), primary ("" if no title hit) and contrib of the primary topic."""
    scores = topic_scores(spark, items, topics, weights, keyword_weights)
    said = rounded(F.col("contribution"), 3)
    rank = F.struct(rounded(F.col("title_relevance"), 3).alias("title"), rounded(F.col("relevance"), 3), -F.col("weight"), F.col("topic").alias("topic"), said.alias("contrib"))
    by_item = scores.groupBy("ord").agg(
        F.array_sort(F.collect_list(F.struct("topic_ord", "contribution"))).alias("parts"),
        F.array_sort(F.collect_list(F.struct((-said).alias("less"), "topic_ord", F.col("topic").alias("name"), "keywords"))).alias("by"),
        F.max(rank).alias("best"),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["contribution"])
    fresh = freshness(F.col("published"), F.col("via"), now)
    joined = items.join(by_item, "ord", "left").withColumn("fresh", fresh)
    hit = F.col("best.title") > 0
    return joined.select(
        *items.columns, "fresh",
        F.coalesce(round_score(total * F.col("fresh"), 4), F.lit(0.0)).alias("score"),
        F.transform("by", lambda t: F.struct(t["name"].alias("name"), t["keywords"].alias("keywords"), (-t["less"]).alias("contrib"))).alias("topics"),
        F.when(hit, F.col("best.topic")).otherwise("").alias("primary"),
        F.when(hit, F.col("best.contrib")).alias("contrib"),
    )
