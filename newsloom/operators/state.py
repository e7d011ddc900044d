"""What is carried from run to run: selected records, and media that were found through searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import normalize_url

KEEP_DAYS = 7
# Collectors that gather other media's articles.
AGGREGATORS = ("はてなブックマーク IT 人気", "はてなブックマーク 学び 人気", "はてなブックマーク アニメとゲーム 人気", "Qiita トレンド")
EXAMPLES = 3


def retained(records: DataFrame, now: Column, days: int = KEEP_DAYS, column: str = "selected_at") -> DataFrame:
    """Records of less than that many days ago."""
    return records.where(now.cast("timestamp").cast("double") - F.col(column).cast("timestamp").cast("double") < days * 86400)


def unseen(rows: DataFrame, seen: DataFrame, url_column: str = "link", seen_column: str = "link") -> DataFrame:
    """rows whose normalised URL isn't that of a seen row; a blank seen URL is none."""
    known = seen.where(F.col(seen_column) != "").select(normalize_url(seen_column).alias("seen_url")).distinct()
    return rows.join(known, normalize_url(url_column) == F.col("seen_url"), "left_anti")


def to_records(selected: DataFrame, selected_at: Column, place: Column) -> DataFrame:
    """What is kept of selected items; place: their order in the run."""
    kept = ["title", "link", "source", "via", "collector", "feed_url", "domain", "lang", "score", "published"]
    topics = F.transform("topics", lambda t: F.struct(t["name"].alias("name"), t["keywords"].alias("keywords")))
    related = F.array_sort(F.array_except("related", F.array("source")))
    return selected.select(*kept, selected_at.alias("selected_at"), topics.alias("topics"), "primary", related.alias("related"), place.cast("int").alias("place"))


def newly_found(records: DataFrame, rss_domains: DataFrame) -> DataFrame:
    """Records from searches or aggregators, of media that aren't configured (rss_domains: domain)."""
    via = (F.col("via") != "RSS") | F.col("collector").isin(*AGGREGATORS)
    named = (F.col("domain") != "") & ~F.col("domain").endswith("news.google.com")
    return records.where(via & named).join(rss_domains.select("domain").distinct(), "domain", "left_anti")


def update_discovered(known: DataFrame, found: DataFrame) -> DataFrame:
    """known (domain, publisher, count, first_seen, last_seen, examples) with the counts of found records.

    found: domain, source, via, title, selected_at and ord, the order of selection. The latest titles come first
    among at most three examples; an entry keeps its first publisher and day.
    """
    day = F.date_format("selected_at", "yyyy-MM-dd")
    publisher = F.when(F.col("via") == "Googleニュース", F.col("source")).otherwise(F.col("domain"))
    new = found.groupBy("domain").agg(
        F.min_by(publisher, "ord").alias("new_publisher"),
        F.count("*").alias("n"),
        F.min_by(day, "ord").alias("new_first"),
        F.max_by(day, "ord").alias("new_last"),
    )
    latest = _latest_titles(found)
    both = known.join(new, "domain", "full_outer").join(latest, "domain", "left")
    empty = F.array().cast("array<string>")
    titles = F.slice(F.concat(F.coalesce("titles", empty), F.coalesce("examples", empty)), 1, EXAMPLES)
    return both.select(
        "domain",
        F.coalesce("publisher", "new_publisher").alias("publisher"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("count"),
        F.coalesce("first_seen", "new_first").alias("first_seen"),
        F.coalesce("new_last", "last_seen").alias("last_seen"),
        titles.alias("examples"),
    )


def _latest_titles(found: DataFrame) -> DataFrame:
    """(domain, titles): the latest titles of each domain, cut to three before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("ord")))
    top = found.select("domain", "title", place.alias("place")).where(F.col("place") <= EXAMPLES)
    listed = top.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("titles"))
    return listed.select("domain", F.transform("titles", lambda t: t["title"]).alias("titles"))
