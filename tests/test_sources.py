import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import plain
from newsloom.functions.times import feed_time, saved_date
from newsloom.functions.urls import domain_of, domain_suffixes, normalize_url, unquoted
from newsloom.sinks.report import write_history, write_history_file
from newsloom.sources import config, feeds, pages, state

TOPICS = """# x
## AI・生成AI
- キーワード: AI, 生成AI、LLM
- 英語：artificial intelligence
- 除外: アートメイク
- 倍率: 2
- 何か: x
- キーワード: GPT
## 暗号資産
- キーワード: ビットコイン
- 扱い: 集めない
"""
SOURCES = """## RSS
| 名前 | 言語 | RSS | 主なトピック |
|---|---|---|---|
| A | ja | URL_A | 半導体 |
| B | ja | URL_B |

| not | a table |
## Googleニュース検索
| 検索語 | 言語 |
|---|---|
| a OR b | ja |
## はてなブックマーク検索
| 検索語 | 最低ブックマーク |
|---|---|
| 宇宙 | 10 |
## 除外する媒体
| 媒体名またはドメイン | 理由 |
|---|---|
| PR TIMES | x |
"""


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


def test_topics():
    ai, coin = config.parse_topics(TOPICS)
    assert (ai.name, ai.keywords, ai.english, ai.exclude, ai.multiplier, ai.collect) == ("AI・生成AI", ["AI", "生成AI", "LLM", "GPT"], ["artificial intelligence"], ["アートメイク"], 2.0, True)
    assert not coin.collect and coin.multiplier == 1.0
    with pytest.raises(ValueError):
        config.parse_topics("nothing")
    assert config.topic_of({"name": "x", "keywords": ["a"]}) == config.Topic("x", ["a"])


def test_sources():
    s = config.parse_sources(SOURCES)
    assert s.rss == [{"name": "A", "lang": "ja", "url": "URL_A", "topics": "半導体"}, {"name": "B", "lang": "ja", "url": "URL_B", "topics": ""}]
    assert s.google == [{"query": "a OR b", "lang": "ja"}] and s.hatena == [{"query": "宇宙", "min_users": 10}] and s.blocked == ["PR TIMES"]
    with pytest.raises(ValueError):
        config.parse_sources("## RSS\n")
    assert [r["kind"] for r in feeds.requests_of(s)] == ["rss", "rss", "hatena", "google"]
    assert feeds.google_url("a b", "ja") == "https://news.google.com/rss/search?q=a+b+when%3A1d&hl=ja&gl=JP&ceid=JP%3Aja"


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://www.Example.com:8080/a/?utm_source=x&b=1&c=&ref=2#top", "https://example.com:8080/a?b=1"),
        (" https://example.com ", "https://example.com"),
        ("https://example.com/p;x?q=a%20b&q=%7Ec*&fbclid=1", "https://example.com/p?q=a+b&q=~c%2A"),
        ("", "https://"),
        (None, "https://"),
    ],
)
def test_urls(spark, url, want):
    assert value(spark, normalize_url, url) == want


def test_small_functions(spark):
    assert value(spark, domain_of, "https://WWW.Example.com:80/x") == "example.com"
    assert value(spark, domain_suffixes, "a.b.c") == ["a.b.c", "b.c", "c"]
    assert value(spark, unquoted, "a%2Fb+c") == "a/b+c"
    assert value(spark, plain, "<p>a&amp;b　 c<br>d</p>") == "a&b c d"
    assert value(spark, saved_date, "Thu, 24 Sep 2026 22:15:16 GMT-4") == "2026-09-25T02:15:16Z"
    assert value(spark, saved_date, "Thu, 24 Sep 2026 24:41:00 GMT+5:30") == "2026-09-23T19:11:00Z"
    assert value(spark, saved_date, "yesterday") == "" == value(spark, saved_date, None)
    assert value(spark, lambda c: feed_time(c).cast("string"), "Tue, 29 Sep 2026 10:00:00 +0900") == "2026-09-29 01:00:00"
    assert value(spark, lambda c: feed_time(c).cast("string"), "2026-09-29T10:00:00+09:00") == "2026-09-29 01:00:00"
    assert value(spark, feed_time, "no date") is None
    for text, want in [("Tue, 29 Sep 2026 10:00:00 EST", "15:00"), ("29 Sep 26 10:00 JST", "01:00"), ("29 Sep 2026 10:00:00 GMT", "10:00"), ("2026-09-29T10:00:00Z", "10:00"), ("Tue, 29 Sep 2026 10:00:00 pdt", "17:00")]:
        assert value(spark, lambda c: feed_time(c).cast("string"), text) == f"2026-09-29 {want}:00"
    assert value(spark, lambda c: feed_time(c).cast("string"), "1 Jan 99 00:00:00 +0000") == "1999-01-01 00:00:00"


ENTRY = """<article id="{id}_main"><a class="x EntryMetadataSource" href="/i/subscription/content/feed%2Fhttp%3A%2F%2Ff.example%2Frss">Site &amp; Co</a>
<a class="EntryTitleLink y" href="https://e.example/?a=1&amp;b=2" rel="x">A <b>title</b></a><i title="Meme" class="InterestingMetadata__icon"></i><span>m1</span>
<div><div><div><div>Some summary</div></div></div><div class="k"><span title="Published: Thu, 24 Sep 2026 22:15:16 GMT-4
Received: Thu, 24 Sep 2026 23:00:00 GMT-4"></span></div></article>"""


def test_saved_pages(spark, tmp_path):
    html = f'<html>before{ENTRY.format(id="e1")}between<article id="e2_main"><span title="Received: Fri, 25 Sep 2026 01:00:00 GMT+0"></article></html>'
    (tmp_path / "a.html").write_text(html)
    mhtml = "From: x\nMIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html; charset=utf-8\n\n<p>s</p>\n--B\nContent-Type: text/html; charset=utf-8\n\n" + html + "\n--B--\n"
    assert "EntryTitleLink" in pages.html_of(mhtml.encode())
    rows = pages.articles(pages.read_pages(spark, str(tmp_path))).orderBy("read_rank").collect()
    assert [r.read_rank for r in rows] == [0, 1]
    first = rows[0].asDict()
    assert {k: first[k] for k in ("entry_id", "source", "feed_url", "title", "url", "feedly_meme", "summary", "published", "received")} == {
        "entry_id": "e1", "source": "Site & Co", "feed_url": "http://f.example/rss", "title": "A title", "url": "https://e.example/?a=1&b=2",
        "feedly_meme": "m1", "summary": "Some summary", "published": "2026-09-25T02:15:16Z", "received": "2026-09-25T03:00:00Z",
    }
    assert first["problems"] == [] and rows[1].problems == ["title", "url", "source", "published"] and rows[1].received == "2026-09-25T01:00:00Z"
    df = pages.articles(pages.read_pages(spark, str(tmp_path)))
    assert pages.extraction_report(df).first().asDict() == {"articles": 2, "published_min": first["published"], "published_max": first["published"], "problems": 4}
    write_history_file(df, str(tmp_path / "out" / "h.csv"))
    write_history(df, str(tmp_path / "csv"))
    assert (tmp_path / "out" / "h.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    for path in ("out/h.csv", "csv"):
        back = pages.read_history(spark, str(tmp_path / path)).orderBy("read_rank").collect()
        assert [tuple(b) for b in back] == [tuple(r[n] for n in pages.HISTORY.fieldNames()) for r in rows]


RSS = """<rss><channel><title>c</title><item><title>半導体 &amp; AI</title><link>https://a.example/1</link><description>&lt;p&gt;x&lt;/p&gt;</description><pubDate>Tue, 29 Sep 2026 10:00:00 +0000</pubDate></item>
<item><title>no link</title></item><item><title>見出し（他社） - Yahoo!ニュース</title><link>https://n.example/2</link><source url="https://news.yahoo.co.jp">Yahoo!ニュース</source></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>atom</title><link href="https://b.example/3"/><summary>s</summary><updated>2026-09-29T09:00:00Z</updated></entry></feed>'


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "bad.xml").write_text("<rss>")
    name = lambda n: (tmp_path / n).as_uri()
    requests = [
        {"kind": k, "position": p, "label": label, "url": name(f), "name": n, "source_topics": t}
        for k, p, label, f, n, t in [("rss", 0, "A", "a.xml", "A", "半導体"), ("rss", 1, "B", "b.xml", "B", ""), ("rss", 2, "bad", "bad.xml", "bad", ""), ("rss", 3, "gone", "gone.xml", "gone", ""), ("hatena", 0, "h", "b.xml", "", ""), ("google", 0, "g", "a.xml", "", "")]
    ]
    found = feeds.parsed(feeds.fetched(spark, requests, 0.0, 0.0)).cache()
    status = {(r.kind, r.label): (r.ok, r["count"]) for r in feeds.statuses(found).collect()}
    assert status == {("rss", "A"): (True, 3), ("rss", "B"): (True, 1), ("rss", "bad"): (False, 0), ("rss", "gone"): (False, 0), ("hatena", "h"): (True, 1), ("google", "g"): (True, 3)}
    assert feeds.healthy(found) and not feeds.healthy(found, 0.6)
    rows = feeds.items(found).orderBy("ord").collect()
    assert [(r.title, r.source, r.via, r.domain) for r in rows] == [
        ("半導体 & AI", "A", "RSS", "a.example"),
        ("見出し（他社） - Yahoo!ニュース", "A", "RSS", "n.example"),
        ("atom", "B", "RSS", "b.example"),
        ("atom", "b.example", "はてブ検索", "b.example"),
        ("半導体 & AI", "Googleニュース", "Googleニュース", ""),
        ("no link", "Googleニュース", "Googleニュース", ""),
        ("見出し", "他社", "Googleニュース", "news.yahoo.co.jp"),
    ]
    assert rows[0].summary == "x" and rows[0].lang == "ja" and rows[0].source_topics == "半導体" and rows[0].published == dt.datetime(2026, 9, 29, 10)
    assert rows[2].published == dt.datetime(2026, 9, 29, 9) and rows[2].lang == "en" and rows[4].summary == ""
    known = feeds.known_source_titles(spark, [{"name": "A", "known": True, "feed_url": name("b.xml")}, {"name": "B", "known": False, "feed_url": "x"}], 0, 0)
    assert [tuple(r) for r in known.collect()] == [("https://b.example/3", "atom", 0)]
    assert feeds.known_source_titles(spark, []).count() == 0


def test_feeds_that_are_not_well_formed():
    body = """<?xml version="1.0" encoding="utf-8"?><rss><channel><title>c</title><item><title>a &amp; b & c</title><link>https://a.example/1?x=1&y=2</link>
<description><![CDATA[<p>x</p>]]></description><dc:date>2026-09-29T10:00:00Z</dc:date><br>
<item><title>two</title><link href="https://b.example/2" /><source url="https://s.example">S</source>"""
    one, two = feeds.entries_of(body.encode())
    assert (one["title"], one["link"], one["summary"], one["published"]) == ("a & b & c", "https://a.example/1?x=1&y=2", "<p>x</p>", "2026-09-29T10:00:00Z")
    assert (two["title"], two["link"], two["source_title"], two["source_href"]) == ("two", "https://b.example/2", "S", "https://s.example")
    with pytest.raises(feeds.ET.ParseError):
        feeds.entries_of(b"<rss>")


def test_state(spark, tmp_path):
    path = str(tmp_path / "s")
    assert state.read_state(spark, path, state.DISCOVERED).count() == 0
    for n in (1, 2):
        rows = spark.createDataFrame([("d", "p", n, "a", "b", ["x"])], state.DISCOVERED)
        state.write_state(spark, rows, path)
        assert [r["count"] for r in state.read_state(spark, path, state.DISCOVERED).collect()] == [n]
    (tmp_path / "s" / "v-unfinished").mkdir()  # a run that failed before its marker
    assert [r["count"] for r in state.read_state(spark, path, state.DISCOVERED).collect()] == [2]
    data = {"topics": [{"name": "a", "weight": 1.0, "allocation": 1.0, "keywords": ["x"]}, {"name": "v", "weight": 0.0, "collect": False}], "known_domains": ["d"]}
    (tmp_path / "p.json").write_text(json.dumps(data))
    p = state.read_profile(str(tmp_path / "p.json"))
    assert [t.name for t in p.topics] == ["a"] and [t.name for t in p.vetoes] == ["v"] and p.allocation == {"a": 1.0} and p.known_domains == ["d"]
