"""A profile's sums as mergeable partials by day.

What a profile needs of a reading history is, for each day, how many rows there were, how many hit each topic and keyword, and
how many had each term. The weight of a row depends on its day alone, so a day's count times the day's weight is what
its rows add to a sum, at any reference date and half-life. A new day, or more rows of an old one, is matched once and
appended; a profile is then made from a row for each day and term and never reads a text again.

Results for odd input: rows without a day have no weight in a profile and aren't counted; null texts hit nothing and count as rows; the
partials of rows that are added twice count twice; an empty history gives no partials.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.tables import written
from newsloom.functions.text import each_of
from newsloom.functions.times import decayed
from newsloom.operators.matching import hits, term_table
from newsloom.plans.profile import HALF_LIFE_DAYS, RECENT_DAYS, Totals, shares_of
from newsloom.sources.config import Topic

KINDS = ("all", "topic", "keyword", "term")
#: kind: all (a row of the history), topic, keyword or term.
PARTIALS = "kind string, topic_ord int, term string, n long, day date"


def day_partials(spark: SparkSession, rows: DataFrame, topics: list[Topic], terms: Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """PARTIALS of rows (id, day, text), ids unique; terms: an array of distinct terms of a row; kinds: those that will be read."""
    held = rows.where(F.col("day").isNotNull())
    parts = [counted(held.select("day"), "all")]
    if "topic" in kinds or "keyword" in kinds:
        found = written(spark, hits(held.select("id", "day", "text"), term_table(spark, topics)).select("day", "topic_ord", F.col("hits.keyword").alias("keywords")), "partial-hits")
        if "keyword" in kinds:
            parts.append(counted(found.select("day", "topic_ord", F.explode("keywords").alias("term")), "keyword"))
        if "topic" in kinds:
            parts.append(counted(found.select("day", "topic_ord"), "topic"))
    if "term" in kinds:
        parts.append(counted(each_of(held, terms, "term", "day"), "term"))
    return reduce(DataFrame.unionByName, parts)


def counted(rows: DataFrame, kind: str) -> DataFrame:
    """PARTIALS of a kind: how many rows are equal."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    lacks = {"topic_ord": F.lit(None).cast("int"), "term": F.lit(None).cast("string")}
    return counts.withColumns({n: c for n, c in lacks.items() if n not in rows.columns}).select("kind", "topic_ord", "term", "n", "day")


def add_partials(partials: DataFrame, path: str) -> None:
    """Append partials to a table with a folder for each day; days that have none of them aren't touched."""
    partials.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTIALS).parquet(path)


class Sums:
    """The sums of a profile at a reference date."""

    def __init__(self, partials: DataFrame, reference, half_life: float = HALF_LIFE_DAYS, recent_days: int = RECENT_DAYS):
        ref = F.lit(reference).cast("date")
        weight = decayed(F.date_diff(ref, F.col("day")), half_life)
        recent = F.col("day") >= F.date_sub(ref, recent_days)
        self.rows = partials.withColumns({"w": F.col("n") * weight, "n_recent": F.when(recent, F.col("n")).otherwise(0)})

    def by(self, kind: str, *keys: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum("n_recent").alias("recent"))

    def totals(self) -> Totals:
        r = self.by("all").first()
        recent = (r.recent if r else 0) or 1
        return Totals((r.w if r else 0.0) or 0.0, recent, ((r.n if r else 0) or 0) - recent or 1)

    def shares(self, spark: SparkSession, topics: list[Topic]) -> DataFrame:
        return shares_of(spark, self.by("topic", "topic_ord"), topics, self.totals())

    def terms(self) -> DataFrame:
        """(term, weighted, count, recent, older)."""
        return self.by("term", "term").select("term", F.col("w").alias("weighted"), F.col("n").alias("count"), "recent", (F.col("n") - F.col("recent")).alias("older"))
