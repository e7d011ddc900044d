"""A feed run: candidates are filtered, scored, clustered into stories, and a few are selected."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.scores import rounded
from newsloom.functions.tables import written
from newsloom.functions.text import story_tokens
from newsloom.operators.exclusion import KNOWN, is_too_old, with_reasons
from newsloom.operators.scoring import with_scores
from newsloom.operators.selection import diverse_selection, largest_remainders
from newsloom.operators.state import unseen
from newsloom.operators.stories import buzz, document_frequencies, representatives, story_clusters
from newsloom.sources.state import Profile

# The limits of a run.
LIMIT = 30
LEAST_SCORE = 0.1
PER_SOURCE = 4


@dataclass
class Ranking:
    selected: DataFrame
    candidates: int
    excluded: dict[str, int]
    too_old: int
    below_threshold: int
    already_seen: int
    same_story: int
    capped: int
    quotas: dict[str, int] = field(default_factory=dict)


def processing_key(group: str, score: Column, order: Column) -> Column:
    """Text that sorts as (group, score descending, order): an order number without a sort of all rows."""
    hexed = lambda number, digits: F.lpad(F.hex(number.cast("long")), digits, "0")
    return F.concat(F.lit(group), hexed(F.lit(10**12) - F.round(score * 10_000), 12), hexed(order, 16))


def considered(spark: SparkSession, items: DataFrame, profile: Profile, blocked: list[str], now: Column, languages: tuple[str, ...] = ("ja",)) -> DataFrame:
    """items with reason: "too_old", a reason for exclusion, or "" with score, fresh, topics, primary and contrib."""
    old = is_too_old(F.col("published"), now)
    young = with_reasons(spark, items.where(~old), profile.known_domains, profile.known_publishers, blocked, profile.vetoes, languages)
    young = written(spark, young, "reasons")
    scored = with_scores(spark, young.where("reason = ''"), profile.topics, profile.weights, profile.keyword_weights, now)
    return scored.unionByName(young.where("reason <> ''"), allowMissingColumns=True).unionByName(items.where(old).withColumn("reason", F.lit("too_old")), allowMissingColumns=True)


def stories(spark: SparkSession, fresh: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Representatives, document frequencies, and how many items were seen or told by others.

    fresh: scored items. seen: (link, title, ord), which come first and keep stories to themselves.
    """
    old = seen.select("link", story_tokens("title").alias("tokens"), processing_key("0", F.lit(0.0), F.col("ord")).alias("ord"))
    new = fresh.withColumns({"tokens": story_tokens("title"), "item_ord": F.col("ord"), "ord": processing_key("1", F.col("score"), F.col("ord"))})
    old, new = written(spark, old, "seen"), written(spark, new, "fresh")
    frequencies = written(spark, document_frequencies(old.select("tokens").unionByName(new.select("tokens"))), "frequencies")
    left = written(spark, unseen(new, old), "unseen")
    titles = old.where(F.size("tokens") > 0).select("ord", "tokens").unionByName(left.select("ord", "tokens"))
    told = story_clusters(spark, titles, frequencies)
    members = written(spark, left.join(told.where(F.col("ord").startswith("1")), "ord"), "members")
    mine = members.where(F.col("story").startswith("1"))
    reps = representatives(mine.select("story", "ord", "source", "via", "score"))
    rows = mine.drop("story").join(reps.withColumnRenamed("rep", "ord"), "ord")
    loud = buzz("related")
    rows = rows.withColumns({"buzz": loud, "score": rounded(F.col("score") * loud, 4), "ord": F.col("story")}).drop("story")
    rows = written(spark, rows, "representatives")
    n_mine, n_reps = mine.count(), rows.count()
    return rows, frequencies, new.count() - n_mine, n_mine - n_reps


def rank(
    spark: SparkSession,
    items: DataFrame,
    profile: Profile,
    blocked: list[str],
    now,
    seen: DataFrame | None = None,
    limit: int = LIMIT,
    least_score: float = LEAST_SCORE,
    per_source: int = PER_SOURCE,
    languages: tuple[str, ...] = ("ja",),
) -> Ranking:
    """items: ITEM rows with unique ord; seen: (link, title, ord) of what was shown before, in its order. selected is in order of score."""
    at = F.lit(now).cast("timestamp")
    rows = written(spark, considered(spark, items, profile, blocked, at, languages), "considered")
    reasons = {r.reason: r["count"] for r in rows.groupBy("reason").count().collect()}
    fresh = rows.where((F.col("reason") == "") & (F.col("primary") != "") & (F.col("score") >= least_score)).drop("reason")
    shown = seen.select("link", "title", "ord") if seen is not None else spark.createDataFrame([], "link string, title string, ord long")
    known = rows.where(F.col("reason") == KNOWN).select("link", "title", (F.col("ord") + F.lit(1 << 62)).alias("ord"))
    n_fresh = fresh.count()
    reps, frequencies, already, same = stories(spark, fresh, shown.unionByName(known))
    shares = spark.createDataFrame([(i, n, float(a)) for i, (n, a) in enumerate(profile.allocation.items())], "ord int, name string, share double")
    quotas = {r["name"]: int(r.quota) for r in largest_remainders(shares, limit).collect()}
    ordered = [(n, quotas[n]) for n in profile.allocation]
    picked = diverse_selection(reps, frequencies.select("token", "idf"), ordered, limit, per_source)
    chosen = reps.where(F.col("ord").isin(picked.ords)) if picked.ords else reps.limit(0)
    total = sum(reasons.values())
    too_old = reasons.pop("too_old", 0)
    return Ranking(chosen.orderBy(F.desc("score"), "ord"), total, {k: v for k, v in reasons.items() if k}, too_old, reasons.get("", 0) - n_fresh, already, same + picked.similar, picked.capped, quotas)
