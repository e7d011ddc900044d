"""Line deduplication by site-relative frequency.

For every site (host) the pages that contain a line are divided by all its pages. Lines above the
boilerplate ratio are dropped from that site's pages, if they repeat at all: a line on one page alone
is no duplicate (`least_pages`, two), however few pages its site has.

A page counts once for each distinct line. Lines are told apart by a 64-bit hash while they are
counted, summed up before they are shuffled, so a hot line or host costs one row a task. What exceeds
the ratio is bounded: a host has at most (its mean number of distinct lines) / ratio such lines. They
are joined to the pages as one array a host: broadcast if their number is within a checked bound, with
a shuffled join otherwise. Texts are cut and joined again where they are, without a shuffle; a page
meets its site's lines in a hash set, once.

Results for odd input: lines that are blank are never dropped; a null text stays null and counts as a
page without lines; an empty text stays empty; very long texts are handled in one piece; rows with a null
host are a site of their own; a line exactly at the ratio stays; repeated rows are pages of their own; an
empty table gives an empty one; the other columns are passed on, whatever their names: a report's columns
have underscores after theirs if the pages have a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import fresh, table, written

RATIO = 0.05
LEAST_PAGES = 2
#: Up to so many boilerplate lines (of 8 bytes each) are broadcast.
BROADCAST_LINES = 500_000


#: A site with more lines has those that a page shares found by a hash set first.
FEW_LINES = 32


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def free(name: str, taken: list[str]) -> str:
    return free(f"{name}_", taken) if name in taken else name


def is_blank(line: Column) -> Column:
    return F.translate(line, " \t\r", "") == ""


def url_host(url: str | Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate(pages: DataFrame, host: Column, text_column: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, line, n_pages, share): hashes of lines on more than `ratio` of their site's pages."""
    site = F.coalesce(host, F.lit("\0")).alias("site")
    hashes = F.array_distinct(F.transform(F.filter(lines_of(F.col(text_column)), lambda x: ~is_blank(x)), lambda x: F.xxhash64(x)))
    totals = pages.select(site).groupBy("site").agg(F.count("*").alias("site_pages"))
    held = pages.select(site, F.explode(hashes).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n_pages"))
    often = held.where(F.col("n_pages") >= least_pages).join(totals, "site").withColumn("share", F.col("n_pages") / F.col("site_pages"))
    return often.where(F.col("share") > ratio).select("site", "line", "n_pages", "share")


def without_boilerplate(
    spark: SparkSession, pages: DataFrame, host: Column, text_column: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, report: bool = False
) -> DataFrame:
    """pages with the text rid of its site's boilerplate lines; with `report` also n_lines and n_dropped."""
    found = written(spark, boilerplate(pages, host, text_column, ratio, least_pages), "boilerplate")
    own_site, own_lines, done = fresh("site"), fresh("lines"), fresh("done")
    sites = found.groupBy(F.col("site").alias(own_site)).agg(F.collect_list("line").alias(own_lines))
    if found.count() <= BROADCAST_LINES:
        sites = F.broadcast(sites)
    joined = pages.join(sites, F.coalesce(host, F.lit("\0")) == F.col(own_site), "left")
    lines = lines_of(F.col(text_column))

    def rid(bad: Column) -> Column:
        kept = F.filter(lines, lambda x: is_blank(x) | ~F.array_contains(bad, F.xxhash64(x)))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(kept).alias("n_kept"))

    # an array of one element binds the lines to look for, so that they are found once and not for each line
    met = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col(own_lines))
    shared = F.array(F.when(F.size(own_lines) <= FEW_LINES, F.col(own_lines)).otherwise(met))
    marked = joined.withColumn(done, F.when(F.col(own_lines).isNotNull() & F.col(text_column).isNotNull(), F.transform(shared, rid)[0]))
    out = [F.coalesce(F.col(f"{done}.text"), F.col(text_column)).alias(text_column) if c == text_column else F.col(c) for c in pages.columns]
    if report:
        n = F.when(F.col(text_column).isNull(), 0).otherwise(F.size(lines))
        counts = {"n_lines": n, "n_dropped": F.coalesce(n - F.col(f"{done}.n_kept"), F.lit(0))}
        out += [count.cast("long").alias(free(name, pages.columns)) for name, count in counts.items()]
    return marked.select(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(spark, docs, F.col("source"), report=True)


SQL = f"""
WITH l AS (SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
total AS (SELECT coalesce(source, chr(0)) AS site, count(*) AS n FROM documents GROUP BY 1),
held AS (SELECT site, line, count(DISTINCT doc_id) AS k FROM l WHERE translate(line, ' ' || chr(9) || chr(13), '') <> '' GROUP BY 1, 2),
bad AS (SELECT held.site, held.line FROM held JOIN total ON held.site = total.site WHERE k >= {LEAST_PAGES} AND k / n > {RATIO}),
marked AS (SELECT l.doc_id, l.line, l.p, bad.line IS NOT NULL AS dropped FROM l LEFT JOIN bad ON l.site = bad.site AND l.line = bad.line),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT dropped) AS text FROM marked GROUP BY 1)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(done.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""
