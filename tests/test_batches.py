"""Pages and feeds go to Python a few at a time, and only those that need it."""

import html

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom import queries
from newsloom.functions.tables import ARROW_ROWS
from newsloom.functions.text import unescaped
from newsloom.functions.times import saved_date
from newsloom.sources import feeds

ODD = ["a & b", "&", "&&amp;", "&amp;lt;", "&amp", "x&ampy", "&#39;&#039;", "&lt;&gt;&quot;", "&ltx", "&notit;", "&eacute; &nbsp;", "&#x41", "&\n", "&<b>", "end &", "&;", "&#;", "", None]


def test_entities_are_those_of_python(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").select("i", unescaped("t")).collect()
    assert dict(map(tuple, got)) == {i: t if t is None else html.unescape(t) for i, t in enumerate(ODD)}


def test_common_entities_stay_out_of_python(spark, monkeypatch):
    broken = F.udf(lambda t: None if t is None else 1 / 0, "string")
    monkeypatch.setattr("newsloom.functions.text._unescaped", broken)
    rows = spark.createDataFrame([("S &amp; M &lt;b&gt;",), ("none",)], "t string").select(unescaped("t").alias("t")).collect()
    assert [r.t for r in rows] == ["S & M <b>", "none"]


@pytest.mark.parametrize("text,want", [("Thu, 24 Sep 2026 22:15:16 GMT-4", "2026-09-25T02:15:16Z"), ("Thu, 1 Jan 2026 24:00:01 GMT+5:30 and/more", "2025-12-31T18:30:01Z"), ("a/b/c/d/e/f/g", ""), ("Thu, 99 Sep 2026 22:15:16 GMT-4", ""), ("", ""), (None, "")])
def test_saved_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(saved_date("t")).first()[0] == want


def test_a_batch_of_feeds_is_parsed_a_few_at_a_time(monkeypatch):
    sizes = []
    one = feeds._parsed_slice
    monkeypatch.setattr(feeds, "_parsed_slice", lambda bodies: sizes.append(len(bodies)) or one(bodies))
    bodies = [b"<rss><item><title>t%d</title></item></rss>" % i if i % 7 else b"<rss>" if i % 2 else None for i in range(1000)]
    (got,) = feeds._parsed.func(iter([pa.array(bodies, pa.binary())]))
    assert len(got) == 1000 and max(sizes) <= feeds.AT_ONCE
    for i, row in enumerate(got.to_pylist()):
        assert [e["title"] for e in row["entries"]] == ([f"t{i}"] if i % 7 else [])
        assert (row["error"] is None) == (bool(i % 7) or not i % 2)


def test_queries_of_pages_set_small_batches(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query in ("feed_entries", "feed_statuses", "feed_rank", "saved_articles"):
            assert hasattr(queries.QUERIES[query], "__wrapped__")
        spark.conf.set(name, 10_000)
        queries.QUERIES["feed_statuses"](spark, sf_dir)
        assert int(spark.conf.get(name)) == 1_000
        spark.conf.set(name, 77)
        queries.QUERIES["feed_statuses"](spark, sf_dir)
        assert int(spark.conf.get(name)) == 77
    finally:
        spark.conf.set(name, before)


def test_feed_rank_hands_each_page_to_python_once(spark, tmp_path, monkeypatch):
    n, log, name = 2 * ARROW_ROWS + 500, str(tmp_path / "batches"), "spark.sql.execution.arrow.maxRecordsPerBatch"

    @F.arrow_udf("string")
    def noted(texts: pa.Array) -> pa.Array:
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())

    monkeypatch.setattr("newsloom.functions.text._ended_unescaped", noted)
    body = F.format_string("<title>Tion &eacute;%d</title><article>the &amp; les</article>", "page_id")
    url = F.format_string("https://h%d.example/%s/1", F.col("page_id") % 9, F.when(F.col("page_id") % 100 == 0, "en").otherwise("de"))
    spark.range(0, n, 1, 1).select(F.col("id").alias("page_id")).select("page_id", url.alias("url"), body.alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        found = queries.QUERIES["feed_rank"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(name, before)
    assert found and all(r.page_id % 100 == 0 for r in found)
    with open(log) as f:
        sizes = list(map(int, f))
    assert max(sizes) <= ARROW_ROWS and sum(sizes) == 2 * n  # a title and an article for each page
