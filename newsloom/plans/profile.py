"""An interest profile from a reading history.

Every step is a DataFrame; what comes to the driver are the aggregates per topic, keyword, source and
term that a profile lists, each bounded by the configuration or a top-k of the report.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.scores import keyword_weight, rounded, trend_label
from newsloom.functions.tables import written
from newsloom.functions.text import each_of, is_japanese, nfkc, story_tokens, telling, text_of
from newsloom.functions.times import decayed, parse_day
from newsloom.functions.urls import netloc, without_www
from newsloom.operators.matching import hits, term_table
from newsloom.sources.config import Topic

# Periods in days, least counts, aggregators' domains.
HALF_LIFE_DAYS = 180
RECENT_DAYS = 90
OLD_DAYS = 500
LEAST_READS = 5
AGGREGATOR_DOMAINS = ("news.google.com", "news.yahoo.co.jp", "news.yahoo.com", "msn.com", "flipboard.com")
BUCKET_ROWS = 100_000


def running_max(rows: DataFrame, order: str, value: Column, name: str, key: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with the greatest value among those with the same or a greater order number (of the same key).

    Order numbers are cut into buckets; within a bucket a window runs, and what comes from the buckets above
    is the running maximum of one value each. So no task holds the whole history.
    """
    keys = [key] if key else []
    cut = rows.withColumns({name: value, "bucket": F.floor(F.col(order) / bucket_rows)})
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, "bucket").agg(F.max(name).alias("top"))
    carried = tops.select(*keys, "bucket", F.max("top").over(above).alias("carried"))
    within = Window.partitionBy(*keys, "bucket").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = carried.withColumnsRenamed({"bucket": "at_bucket"} | {k: f"at_{k}" for k in keys})
    met = F.col("bucket") == F.col("at_bucket")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"at_{k}"))
    joined = cut.withColumn(name, F.max(name).over(within)).join(carried, met)
    return joined.select(*rows.columns, F.greatest(name, "carried").alias(name))


def with_est_read(history: DataFrame) -> DataFrame:
    """history with est_read: reading order is known, times are not, so the latest time of what was read before bounds it."""
    return running_max(history, "read_rank", F.coalesce(F.nullif("received", F.lit("")), F.col("published")), "est_read")


def with_weights(rows: DataFrame, day: Column, reference, half_life: float = HALF_LIFE_DAYS, recent_days: int = RECENT_DAYS) -> DataFrame:
    """rows with age in days, w and recent, by their day and a reference date."""
    ref = F.lit(reference).cast("date")
    dated = rows.withColumn("age", F.date_diff(ref, day))
    return dated.withColumns({"w": decayed(F.col("age"), half_life), "recent": day >= F.date_sub(ref, recent_days)})


@dataclass
class Totals:
    weight: float
    recent: int
    older: int


def totals(rows: DataFrame) -> Totals:
    r = rows.agg(F.sum("w").alias("w"), F.sum(F.col("recent").cast("long")).alias("recent"), F.count("*").alias("n")).first()
    recent = r.recent or 1
    return Totals(r.w or 0.0, recent, (r.n - recent) or 1)


def topic_hits(spark: SparkSession, rows: DataFrame, topics: list[Topic], id_column: str, text_column: str) -> DataFrame:
    """(id, w, recent, topic_ord, topic, hits): one row per row and topic it hits; ids are unique."""
    texts = rows.select(F.col(id_column).alias("id"), "w", "recent", F.col(text_column).alias("text"))
    return hits(texts, term_table(spark, topics))


def topic_table(spark: SparkSession, topics: list[Topic]) -> DataFrame:
    rows = [(i, t.name, t.collect, float(t.multiplier)) for i, t in enumerate(topics)]
    return spark.createDataFrame(rows, "topic_ord int, topic string, collect boolean, multiplier double")


def topic_shares(spark: SparkSession, found: DataFrame, topics: list[Topic], total: Totals) -> DataFrame:
    """Per topic, hit or not: share of the weight, count, rates of recent and older rows, trend."""
    return shares_of(spark, found.groupBy("topic_ord").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.sum(F.col("recent").cast("long")).alias("recent")), topics, total)


def shares_of(spark: SparkSession, sums: DataFrame, topics: list[Topic], total: Totals) -> DataFrame:
    """The same from the sums (w, n, recent) of each topic_ord."""
    rows = topic_table(spark, topics).join(F.broadcast(sums), "topic_ord", "left").fillna({"w": 0.0, "n": 0, "recent": 0})
    recent, older = F.col("recent") / total.recent, (F.col("n") - F.col("recent")) / total.older
    return rows.select(
        "topic_ord", "topic", "collect", "multiplier",
        rounded(F.col("w") / F.lit(total.weight or 1.0), 4).alias("share"), F.col("n").alias("count"),
        rounded(recent, 4).alias("recent_rate"), rounded(older, 4).alias("older_rate"), trend_label(recent, older).alias("trend"),
    )


def topic_weights(shares: DataFrame) -> DataFrame:
    """shares with base_weight (square root of the share, relative to the greatest), weight (greatest 1) and allocation (sum 1)."""
    everything = Window.partitionBy()  # the topics of a configuration
    collected = F.col("collect")
    top = F.max(F.when(collected, F.col("share"))).over(everything)
    base = F.when((F.col("share") > 0) & collected, rounded(F.sqrt(F.col("share") / F.when(top > 0, top).otherwise(1.0)), 3)).otherwise(0.0)
    raw = shares.withColumn("base_weight", base).withColumn("raw", F.col("base_weight") * F.col("multiplier"))
    greatest, whole = (f(F.when(collected, F.col("raw"))).over(everything) for f in (F.max, F.sum))
    or_one = lambda c: F.when(c > 0, c).otherwise(1.0)
    return raw.withColumns({"weight": rounded(F.col("raw") / or_one(greatest), 3), "allocation": rounded(F.col("raw") / or_one(whole), 4)}).drop("raw")


def keyword_stats(spark: SparkSession, found: DataFrame, topics: list[Topic]) -> DataFrame:
    """Per topic and term: weighted, count and keyword_weight; a term defined twice is counted twice, and unused ones have 0."""
    terms = [(i, t.name, k, k in t.english, t.terms.index(k)) for i, t in enumerate(topics) for k in dict.fromkeys(t.terms)]
    defined = spark.createDataFrame(terms, "topic_ord int, topic string, term string, is_english boolean, pos int")
    seen = found.select("topic_ord", "w", F.explode("hits.keyword").alias("term")).groupBy("topic_ord", "term").agg(F.sum("w").alias("observed"), F.count("*").alias("count"))
    rows = defined.join(F.broadcast(seen), ["topic_ord", "term"], "left").fillna({"observed": 0.0, "count": 0})
    top = F.max("observed").over(Window.partitionBy("topic_ord"))  # the terms of a topic
    weight = keyword_weight(F.col("observed"), F.when(top > 0, top).otherwise(1.0), F.col("is_english"))
    return rows.select("topic_ord", "topic", "term", "pos", rounded(F.col("observed"), 2).alias("weighted"), "observed", "count", weight.alias("keyword_weight"))


def first_rows(found: DataFrame, rows: DataFrame, id_column: str, n: int, *columns: str) -> DataFrame:
    """The first n rows of each topic by id, with columns of rows."""
    place = F.row_number().over(Window.partitionBy("topic_ord").orderBy("id"))
    top = found.select("topic_ord", "topic", "id", place.alias("place")).where(F.col("place") <= n)
    return top.join(rows.select(F.col(id_column).alias("id"), *columns), "id")


def with_domain(rows: DataFrame, url_column: str = "url") -> DataFrame:
    return rows.withColumn("domain", without_www(netloc(text_of(url_column))))


def source_domains(rows: DataFrame, order: str) -> DataFrame:
    """(source, domain, n, first_ord, w, feed): rows (source, domain, w, feed_url) summed up by source and domain."""
    feed = F.min_by("feed_url", F.when(F.col("feed_url") != "", F.col(order)))
    first_feed = F.min(F.when(F.col("feed_url") != "", F.col(order)))
    return rows.groupBy("source", "domain").agg(F.count("*").alias("n"), F.min(order).alias("first_ord"), F.sum("w").alias("w"), feed.alias("feed"), first_feed.alias("feed_ord"))


def source_stats(domains: DataFrame, total: Totals, least: int = LEAST_READS) -> DataFrame:
    """Per source: count, share, its commonest domain (the first met of equals), first feed URL, and whether it is known."""
    rows = domains.groupBy("source").agg(
        F.sum("n").alias("count"),
        rounded(F.sum("w") / F.lit(total.weight or 1.0), 4).alias("share"),
        F.max_by("domain", F.struct("n", -F.col("first_ord"))).alias("domain"),
        F.coalesce(F.min_by("feed", "feed_ord"), F.lit("")).alias("feed_url"),
    )
    return rows.withColumn("known", F.col("count") >= least)


def known_domains(domains: DataFrame, least: int = LEAST_READS) -> DataFrame:
    """Domains with at least `least` reads within a source that has as many, aggregators excepted."""
    known = domains.groupBy("source").agg(F.sum("n").alias("reads")).where(F.col("reads") >= least).select("source")
    return domains.where((F.col("n") >= least) & ~F.col("domain").isin(*AGGREGATOR_DOMAINS)).join(known, "source", "left_semi").select("domain").distinct()


def term_stats(rows: DataFrame, terms: Column) -> DataFrame:
    """Per term of rows (w, recent): weighted, count, recent, older, in one pass; terms are an array of distinct ones."""
    recent = F.sum(F.col("recent").cast("long"))
    return each_of(rows, terms, "term", "w", "recent").groupBy("term").agg(F.sum("w").alias("weighted"), F.count("*").alias("count"), recent.alias("recent"), (F.count("*") - recent).alias("older"))


def uncovered(spark: SparkSession, stats: DataFrame, topics: list[Topic]) -> DataFrame:
    """Terms that no topic defines, width and case aside."""
    covered = spark.createDataFrame([(k,) for t in topics for k in t.terms], "defined string").select(F.lower(nfkc("defined")).alias("defined")).distinct()
    return stats.join(F.broadcast(covered), F.lower(nfkc("term")) == F.col("defined"), "left_anti")


def rising(stats: DataFrame, total: Totals, least: int = 8, least_recent: int = 5, factor: float = 2.0) -> DataFrame:
    """Terms whose recent rate is more than `factor` times the older one."""
    recent, older = F.col("recent") / total.recent, F.col("older") / total.older
    rows = stats.where((F.col("count") >= least) & (F.col("recent") >= least_recent) & (recent > factor * older))
    return rows.select("term", "recent", "older", rounded(recent / F.greatest(older, F.lit(1e-9)), 1).alias("ratio"))


def history_stats(rows: DataFrame, matched: DataFrame, old_days: int = OLD_DAYS) -> DataFrame:
    """One row of figures on rows (read_rank, title, source, url, published, est_read, age); matched: ids of rows in a collected topic."""
    old, published = F.col("age") > old_days, F.nullif("published", F.lit(""))
    flagged = rows.join(matched.select(F.col("id").alias("read_rank"), F.lit(1).alias("hit")).distinct(), "read_rank", "left")
    return flagged.agg(
        F.count("*").alias("articles"),
        F.min(published).alias("published_min"),
        F.max(published).alias("published_max"),
        F.min(F.when(~old, F.col("est_read"))).alias("est_read_min_main"),
        F.sum(is_japanese("title").cast("long")).alias("japanese_titles"),
        F.sum((~is_japanese("title")).cast("long")).alias("other_titles"),
        F.count("hit").alias("matched_any_topic"),
        F.sum(old.cast("long")).alias("old_items"),
        F.array_sort(F.collect_set(F.when(old, F.left(published, F.lit(4))))).alias("old_items_published_years"),
        F.count_distinct("url").alias("known_urls_count"),
    )


def build_profile(spark: SparkSession, history: DataFrame, topics: list[Topic], half_life: float = HALF_LIFE_DAYS, terms: Column | None = None, now: dt.datetime | None = None) -> dict:
    """The profile of a history (HISTORY rows) as a dict that can be stored as JSON.

    terms: an array column of the terms of a title; story tokens with a letter unless given (noun_terms of a
    tokenizer's words can take their place). What comes to the driver is what the JSON holds: a row for each
    topic, keyword, medium and known domain of one reader, and samples.
    """
    dated = with_est_read(history).withColumn("day", parse_day("est_read"))
    reference = dated.agg(F.max("day")).first()[0]
    rows = written(spark, with_domain(with_weights(dated, F.col("day"), reference, half_life)), "history")
    total = totals(rows)
    found = written(spark, topic_hits(spark, rows, topics, "read_rank", "title"), "topic_hits")
    weights = topic_weights(topic_shares(spark, found, topics, total)).orderBy(F.desc("share"), "topic_ord").collect()
    keywords = keyword_stats(spark, found, topics).orderBy("topic_ord", F.desc("observed"), "pos").collect()
    samples = first_rows(found, rows, "read_rank", 5, "title").orderBy("topic_ord", "place").collect()
    stats = written(spark, term_stats(rows, telling(story_tokens("title")) if terms is None else terms), "terms")
    free = uncovered(spark, stats, topics)
    domains = written(spark, source_domains(rows, "read_rank"), "domains")
    sources = [r.asDict() for r in source_stats(domains, total).withColumnRenamed("source", "name").orderBy(F.desc("share"), "name").toLocalIterator()]
    collected = found.join(F.broadcast(topic_table(spark, topics).where("collect")), "topic_ord", "left_semi")
    unmatched = rows.join(collected.select(F.col("id").alias("read_rank")).distinct(), "read_rank", "left_anti")
    old = rows.where(F.col("age") > OLD_DAYS).groupBy("source").count().orderBy(F.desc("count"), "source").collect()
    listed = lambda df, n: [{"term": r.term, "weighted": round(r.weighted, 1), "count": r["count"]} for r in df.orderBy(F.desc("weighted"), "term").limit(n).collect()]
    figures = history_stats(rows, collected).first().asDict()
    known_urls = figures.pop("known_urls_count")
    out = []
    for w in weights:
        t = topics[w.topic_ord]
        own = [k for k in keywords if k.topic_ord == w.topic_ord]
        out.append(
            {k: w[k] for k in ("share", "count", "recent_rate", "older_rate", "trend", "collect", "multiplier", "base_weight", "weight", "allocation")}
            | {
                "name": t.name,
                "keywords": t.keywords,
                "english": t.english,
                "exclude": t.exclude,
                "keywords_observed": [{"term": k.term, "weighted": k.weighted, "count": k["count"]} for k in own if k["count"]],
                "keywords_unused": [k.term for k in sorted(own, key=lambda k: k.pos) if not k["count"]],
                "keyword_weights": {k.term: k.keyword_weight for k in sorted(own, key=lambda k: k.pos)},
                "samples": [s.title for s in samples if s.topic_ord == w.topic_ord],
            }
        )
    return {
        "version": 1,
        "generated_at": (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "params": {"half_life_days": half_life, "reference_date": str(reference), "recent_days": RECENT_DAYS},
        "stats": figures | {"old_items_sources": [[r.source, r["count"]] for r in old]},
        "topics": out,
        "sources": sources,
        "known_domains": sorted(r.domain for r in known_domains(domains).toLocalIterator()),
        "known_publishers": sorted(s["name"] for s in sources if s["known"]),
        "known_urls_count": known_urls,
        "top_terms": listed(stats, 60),
        "uncovered_top_terms": listed(free, 40),
        "rising_uncovered_terms": [r.asDict() for r in rising(free, total).orderBy(F.desc("recent"), "term").limit(30).collect()],
        "unmatched_samples": [f"{r.source}｜{r.title}" for r in unmatched.orderBy("read_rank").limit(15).collect()],
    }
