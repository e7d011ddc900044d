"""Which candidates aren't considered, and why: the first reason that holds, in a fixed order.

Domains match exactly or as a parent, by an equi-join of a domain's suffixes with the list; names match
when normalised, or as each other's beginning. The lists are configuration or a profile's, whose size is checked
before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.tables import written
from newsloom.functions.text import norm_name, text_of
from newsloom.functions.urls import domain_suffixes
from newsloom.operators.matching import vetoes
from newsloom.sources.config import Topic

# Reasons, patterns of titles, company forms, limits.
KNOWN, ENGLISH, AD, GALLERY, COMPANY, BLOCKED = "既読ソース", "英語記事", "広告記事", "画像ページ", "企業の自社発表", "除外する媒体"
AD_TITLE = "【PR】|［PR］|\\[PR\\]|（PR）|\\(PR\\)|\\bSponsored\\b|\\bSPONSORED\\b"
GALLERY_TITLE = "(?U)^【画像】|\\s\\d+/\\d+$"
COMPANY_FORMS = "^(株式会社|合同会社|有限会社)"
MAX_AGE_HOURS = 72
LEAST_NAME = 3
BROADCAST_NAMES = 100_000
#: Plain strings of which the titles above must hold one, which is tested first.
AD_HINTS, GALLERY_HINTS = ("PR", "ponsored", "PONSORED"), ("画像", "/")


def is_too_old(published: Column, now: Column, hours: float = MAX_AGE_HOURS) -> Column:
    """A future or missing date isn't too old."""
    return F.coalesce((now.cast("double") - published.cast("double")) > hours * 3600, F.lit(False))


def hinted(text: Column, hints: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for h in hints:
        found = found | text.contains(h)
    return found


def listed(names: DataFrame) -> DataFrame:
    """names, as a broadcast side if there are few enough."""
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def in_domains(rows: DataFrame, domains: DataFrame, id_column: str, domain_column: str = "domain") -> DataFrame:
    """The distinct ids of rows whose domain is in domains (domain) or below one of them."""
    suffixes = rows.select(id_column, F.explode(domain_suffixes(F.lower(text_of(domain_column)))).alias("domain")).where("domain <> ''")
    return suffixes.join(listed(domains.select(F.lower("domain").alias("domain")).distinct()), "domain", "left_semi").select(id_column).distinct()


def beginnings(name: Column) -> Column:
    """All beginnings of a name, from LEAST_NAME characters on."""
    return F.when(F.length(name) >= LEAST_NAME, F.transform(F.sequence(F.lit(LEAST_NAME), F.length(name)), lambda n: F.left(name, n))).otherwise(F.array().cast("array<string>"))


def known_publishers(rows: DataFrame, publishers: DataFrame, name_column: str = "source") -> DataFrame:
    """The distinct names of rows that equal, begin or are begun by a name of publishers (name), when normalised.

    Two equi-joins on beginnings instead of a test of all pairs.
    """
    names = rows.select(F.col(name_column).alias("name")).distinct().withColumn("n", norm_name("name")).where(F.length("n") >= LEAST_NAME)
    known = publishers.select(norm_name("name").alias("k")).where(F.length("k") >= LEAST_NAME).distinct()
    longer = names.select("name", F.explode(beginnings(F.col("n"))).alias("k")).join(listed(known), "k", "left_semi").select("name")
    shorter = names.join(listed(known.select(F.explode(beginnings(F.col("k"))).alias("n")).distinct()), "n", "left_semi").select("name")
    return longer.union(shorter).distinct()


def with_reasons(spark: SparkSession, items: DataFrame, known_domains: list[str], known_names: list[str], blocked: list[str], veto_topics: list[Topic], languages: tuple[str, ...] = ("ja",)) -> DataFrame:
    """items (with a unique ord) with reason, "" for those to be considered."""
    column = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    # lists meet distinct domains and names, whose flags then meet the items; only vetoes are by item
    domains = items.select(text_of("domain").alias("at_domain")).distinct()
    at_known = in_domains(domains, column(known_domains, "domain"), "at_domain", "at_domain").withColumn("known_domain", F.lit(True))
    at_blocked = in_domains(domains, column([b for b in blocked if "." in b and " " not in b], "domain"), "at_domain", "at_domain").withColumn("blocked_domain", F.lit(True))
    flagged = at_known.join(at_blocked, "at_domain", "full")
    named = known_publishers(items.where("via <> 'RSS'"), column(known_names, "name")).select(F.col("name").alias("at_source"), F.lit(True).alias("known_name"))
    names = items.select(text_of("source").alias("at_source")).distinct().withColumn("n", norm_name("at_source"))
    at_names = names.join(listed(column(blocked, "name").select(norm_name("name").alias("n")).distinct()), "n", "left_semi").select("at_source", F.lit(True).alias("blocked_name"))
    sources = named.join(at_names, "at_source", "full")
    vetoed = vetoes(spark, items, veto_topics).withColumnRenamed("ord", "at_ord")
    joined = (
        items.join(listed(written(spark, flagged, "domains")), F.col("at_domain") == text_of("domain"), "left")
        .join(listed(written(spark, sources, "names")), F.col("at_source") == text_of("source"), "left")
        .join(listed(written(spark, vetoed, "vetoes")), F.col("at_ord") == F.col("ord"), "left")
    )
    reason = (
        F.when(F.col("known_domain") | (F.col("known_name") & (F.col("via") != "RSS")), KNOWN)
        .when(~F.col("lang").isin(*languages) | F.col("lang").isNull(), ENGLISH)
        .when(hinted(F.col("title"), AD_HINTS) & F.col("title").rlike(AD_TITLE), AD)
        .when(hinted(F.col("title"), GALLERY_HINTS) & F.col("title").rlike(GALLERY_TITLE), GALLERY)
        .when((F.col("via") == "Googleニュース") & F.col("source").rlike(COMPANY_FORMS), COMPANY)
        .when(F.col("blocked_name") | F.col("blocked_domain"), BLOCKED)
        .when(F.col("veto").isNotNull(), F.concat(F.lit("集めない話題（"), F.col("veto"), F.lit("）")))
        .otherwise("")
    )
    return joined.select(*items.columns, reason.alias("reason"))
