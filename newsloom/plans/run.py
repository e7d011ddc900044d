"""The three runs as commands: extract a history, build a profile, publish a feed.

    python -m newsloom.plans.run extract PAGES OUT.csv
    python -m newsloom.plans.run profile HISTORY.csv TOPICS.md OUT_DIR [--half-life 180]
    python -m newsloom.plans.run feed PROFILE.json SOURCES.md OUT_DIR [--limit 30] [--min-score 0.1] [--dry-run]
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.tables import written
from newsloom.functions.text import is_japanese
from newsloom.functions.urls import domain_of
from newsloom.operators.state import KEEP_DAYS, newly_found, retained, to_records, update_discovered
from newsloom.plans.feed import LEAST_SCORE, LIMIT, rank
from newsloom.plans.profile import HALF_LIFE_DAYS, build_profile
from newsloom.sinks.feed import Channel, page, rss
from newsloom.sinks.report import write_history_file, write_profile
from newsloom.sources.config import read_sources, read_topics
from newsloom.sources.feeds import fetched, healthy, items, known_source_titles, parsed, requests_of, statuses
from newsloom.sources.pages import articles, extraction_report, read_history, read_pages
from newsloom.sources.state import DISCOVERED, RECORDS, read_profile
from newsloom.sources.store import Change, Store, update_buckets

ONCE = "once"
CHANNEL = Channel("Missed news", "https://example.com/", "News from media that are not read yet")


def extract(spark: SparkSession, pages: str, out: str) -> None:
    rows = written(spark, articles(read_pages(spark, pages)), "articles")
    write_history_file(rows, out)
    print(extraction_report(rows).first().asDict())
    for r in rows.where("size(problems) > 0").orderBy("read_rank").limit(20).collect():
        print(f"{r.read_rank}: {', '.join(r.problems)}")


def profile(spark: SparkSession, history: str, topics: str, out: str, half_life: float = HALF_LIFE_DAYS) -> None:
    write_profile(build_profile(spark, read_history(spark, history), read_topics(topics), half_life), out)


def feed(
    spark: SparkSession,
    profile_path: str,
    sources_path: str,
    out: str,
    now: dt.datetime,
    limit: int = LIMIT,
    least_score: float = LEAST_SCORE,
    dry_run: bool = False,
    channel: Channel = CHANNEL,
    pause_s: float = 1.0,
    wait_s: float = 2.0,
) -> int:
    """0, or 1 if too few feeds could be read: then nothing is written.

    Records, found media, feed and page become visible by one commit. Records are kept by day and found media in
    buckets, of which a run writes those that it changes.
    """
    store = Store(spark, f"{out}/state")
    if not dry_run:
        store.publish(out)  # if the run before ended between its commit and this
    known, sources = read_profile(profile_path), read_sources(sources_path)
    feeds = written(spark, parsed(fetched(spark, requests_of(sources), pause_s, wait_s)), "feeds")
    if not healthy(feeds):
        print("too few feeds could be read; nothing is published")
        return 1
    at = F.lit(now).cast("timestamp")
    kept = written(spark, retained(store.read("items", RECORDS), at), "kept")
    # what was shown comes first, the latest run before earlier ones and each in its order of selection; then what media show
    latest = F.row_number().over(Window.partitionBy().orderBy(F.desc("selected_at"), "place", "link")).cast("long")  # a week's records
    after = known_source_titles(spark, known.sources, pause_s, wait_s).withColumn("ord", F.col("ord") + (1 << 60))
    shown = kept.select("link", "title", latest.alias("ord")).unionByName(after)
    found = rank(spark, written(spark, items(feeds), "items"), known, sources.blocked, now, written(spark, shown, "shown"), limit, least_score)
    print(f"excluded {found.excluded}, too old {found.too_old}, below {found.below_threshold}, seen {found.already_seen}, same story {found.same_story}, capped {found.capped}, quotas {found.quotas}")
    if dry_run:
        found.selected.select("score", "primary", "title", "source").show(limit, truncate=60)
        return 0
    chosen = written(spark, found.selected.withColumn("place", F.row_number().over(_by_score())), "selected")
    new = written(spark, to_records(chosen, at, F.col("place")), "new")
    records = new.unionByName(kept.where(is_japanese("title")))
    rss_domains = spark.createDataFrame([(s["url"],) for s in sources.rss], "url string").select(domain_of("url").alias("domain"))
    media = newly_found(chosen.select("domain", "source", "via", "collector", "title", at.alias("selected_at"), F.col("place").alias("ord")), rss_domains)
    with Change(store) as change:
        keep_days(change, new, now)
        update_buckets(change, "discovered", DISCOVERED, written(spark, media, "media"), "domain", update_discovered)
        change.file("feed.xml", rss(records, channel, now))
        change.file("index.html", page(records, store.read("discovered", DISCOVERED, manifest=change.after), statuses(feeds), channel, now))
    store.publish(out)
    store.vacuum()
    return 0


def keep_days(change: Change, new: DataFrame, now: dt.datetime) -> None:
    """Add records to their days and drop days that are over; what isn't Japanese is kept for one run."""
    first = f"{now.astimezone(dt.timezone.utc) - dt.timedelta(days=KEEP_DAYS):%Y-%m-%d}"
    change.drop("items", [p for p in change.before["tables"].get("items", {}) if p < first or p == ONCE])
    change.put("items", new, F.when(is_japanese("title"), F.date_format("selected_at", "yyyy-MM-dd")).otherwise(ONCE))


def _by_score():
    return Window.partitionBy().orderBy(F.desc("score"), "ord")  # at most `limit` rows


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("extract", ("pages", "out")), ("profile", ("history", "topics", "out")), ("feed", ("profile", "sources", "out"))):
        own = commands.add_parser(name)
        for p in places:
            own.add_argument(p)
        if name == "profile":
            own.add_argument("--half-life", type=float, default=HALF_LIFE_DAYS)
        if name == "feed":
            own.add_argument("--limit", type=int, default=LIMIT)
            own.add_argument("--min-score", type=float, default=LEAST_SCORE)
            own.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "extract":
        extract(spark, a.pages, a.out)
    elif a.command == "profile":
        profile(spark, a.history, a.topics, a.out, a.half_life)
    else:
        return feed(spark, a.profile, a.sources, a.out, dt.datetime.now(dt.timezone.utc).replace(microsecond=0), a.limit, a.min_score, a.dry_run)
    return 0


if __name__ == "__main__":
    sys.exit(main())
