import datetime as dt
import json
import math
import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from newsloom.functions.text import story_tokens
from newsloom.operators.state import newly_found, retained, unseen, update_discovered
from newsloom.plans import partials, profile, run
from newsloom.sinks.report import markdown, topic_bars, write_profile
from newsloom.sources.config import Topic
from newsloom.sources.pages import HISTORY
from newsloom.sources.state import DISCOVERED, read_profile
from newsloom.streaming.items import fresh_once, run_batches
from newsloom.streaming.state import keyed_state, remembered
from tests.test_matching import plain_match

TOPICS = [Topic("AI", ["AI", "生成AI", "GPU"], ["robot"], multiplier=2.0), Topic("宇宙", ["宇宙", "ロケット"]), Topic("株", ["株価"], collect=False)]


def history(n=60, seed=1):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.datetime(2026, 9, 1) - dt.timedelta(days=i * 3 + pick.randint(0, 5))
        source = pick.choice(["A", "B", "C"])
        title = " ".join(pick.choices(["AI", "生成AIの話", "宇宙開発", "ロケット", "株価", "robots", "weather", "cooking"], k=3))
        stamp = day.strftime("%Y-%m-%dT%H:%M:%SZ")
        rows.append((i, title, source, f"https://www.{source.lower()}.example/{i % 50}", stamp if pick.random() < 0.8 else "", stamp, "feed" if i % 4 else "", "", "", str(i)))
    return rows


def plain_est_read(rows):
    out, last = {}, ""
    for r in reversed(rows):
        last = max(last, r[5] or r[4])
        out[r[0]] = last
    return out


def test_profile(spark, tmp_path):
    rows = history()
    df = spark.createDataFrame(rows, HISTORY)
    found = profile.build_profile(spark, df, TOPICS)
    est = plain_est_read(rows)
    day = {k: dt.date.fromisoformat(v[:10]) for k, v in est.items()}
    ref = max(day.values())
    w = {k: 0.5 ** ((ref - d).days / 180) for k, d in day.items()}
    total = sum(w.values())
    assert found["params"]["reference_date"] == str(ref)
    for t in TOPICS:
        hit = {r[0]: plain_match(t, r[1]) for r in rows}
        got = next(x for x in found["topics"] if x["name"] == t.name)
        assert got["count"] == sum(map(bool, hit.values())) and math.isclose(got["share"], sum(w[k] for k, h in hit.items() if h) / total, abs_tol=1e-4)
        counted = {k: sum(k in h for h in hit.values()) for k in t.terms}
        assert {k["term"]: k["count"] for k in got["keywords_observed"]} == {k: n for k, n in counted.items() if n}
        assert got["keywords_unused"] == [k for k in t.terms if not counted[k]]
        assert got["samples"] == [r[1] for r in rows if hit[r[0]]][:5]
    ai = next(x for x in found["topics"] if x["name"] == "AI")
    assert ai["weight"] == 1.0 and ai["keyword_weights"]["GPU"] == 0.4 and sum(x["allocation"] for x in found["topics"]) <= 1.0002
    assert found["known_domains"] == ["a.example", "b.example", "c.example"] and found["known_publishers"] == ["A", "B", "C"]
    assert found["stats"]["articles"] == 60 and found["known_urls_count"] == len({r[3] for r in rows})
    assert "weather" in [x["term"] for x in found["uncovered_top_terms"]]
    write_profile(found, str(tmp_path))
    assert read_profile(str(tmp_path / "profile.json")).weights["AI"] == 1.0
    text = markdown(json.loads((tmp_path / "profile.json").read_text()))
    assert "| 1 | AI |" in text and "集めない話題: 株" in text
    weights = spark.createDataFrame([("a", True, 0.6), ("b", True, 0.3)], "topic string, collect boolean, allocation double")
    assert [r.bar for r in topic_bars(weights, 4).orderBy("topic").collect()] == ["████", "██░░"]


def test_profile_from_partials_equals_the_one_made_anew(spark, tmp_path):
    """Whatever increments the history came in, and at a later reference date as well."""
    rows = [(r[0], r[1], (r[4] or r[5])[:10]) for r in history(120, 7)] + [(500, None, "2026-08-01"), (501, "AI no day", None)]
    df = spark.createDataFrame(rows, "id long, text string, day string").withColumn("day", F.to_date("day"))
    path = str(tmp_path / "partials")
    for k in range(3):
        partials.add_partials(partials.day_partials(spark, df.where(F.col("id") % 3 == k), TOPICS, story_tokens("text")), path)
    for reference in (dt.date(2026, 9, 1), dt.date(2027, 2, 1)):
        anew = profile.with_weights(df.where("day IS NOT NULL"), F.col("day"), reference)
        sums = partials.Sums(partials.read_partials(spark, path), reference)
        want, got = profile.totals(anew), sums.totals()
        assert math.isclose(want.weight, got.weight, rel_tol=1e-9) and (want.recent, want.older) == (got.recent, got.older)
        shares = profile.topic_shares(spark, profile.topic_hits(spark, anew, TOPICS, "id", "text"), TOPICS, want)
        assert sorted(shares.collect()) == sorted(sums.shares(spark, TOPICS).collect())
        terms = {r.term: r for r in profile.term_stats(anew, story_tokens("text")).collect()}
        found = {r.term: r for r in sums.terms().collect()}
        assert terms.keys() == found.keys()
        assert all(math.isclose(terms[t].weighted, found[t].weighted, rel_tol=1e-9) and terms[t][2:] == found[t][2:] for t in terms)
    assert partials.day_partials(spark, df.limit(0), TOPICS, story_tokens("text")).count() == 0


def test_running_maximum_over_buckets(spark):
    rows = history(200, 4)
    df = profile.running_max(spark.createDataFrame(rows, HISTORY), "read_rank", F.coalesce(F.nullif("received", F.lit("")), F.col("published")), "est_read", bucket_rows=7)
    assert {r.read_rank: r.est_read for r in df.collect()} == plain_est_read(rows)


def test_carried_state(spark):
    now = dt.datetime(2026, 9, 29)
    rows = spark.createDataFrame([(i, now - dt.timedelta(days=i)) for i in range(10)], "i int, selected_at timestamp")
    assert retained(rows, F.lit(now)).count() == 7
    links = spark.createDataFrame([("http://www.a.example/x/?utm_source=1",), ("https://b.example",)], "link string")
    seen = spark.createDataFrame([("https://a.example/x",), ("",)], "link string")
    assert [r.link for r in unseen(links, seen).collect()] == ["https://b.example"]
    schema = "ord long, domain string, source string, via string, collector string, title string, selected_at timestamp"
    new = [(i, d, f"p{i}", via, c, f"t{i}", now) for i, (d, via, c) in enumerate([("x.example", "はてブ検索", ""), ("x.example", "Googleニュース", ""), ("y.example", "RSS", ""), ("z.example", "RSS", "Qiita トレンド"), ("", "はてブ検索", ""), ("news.google.com", "Googleニュース", ""), ("rss.example", "はてブ検索", "")] + [("x.example", "はてブ検索", "")] * 3)]
    found = newly_found(spark.createDataFrame(new, schema), spark.createDataFrame([("rss.example",)], "domain string"))
    known = spark.createDataFrame([("z.example", "Z", 4, "2026-01-01", "2026-01-02", ["old"]), ("q.example", "Q", 1, "2026-01-01", "2026-01-01", [])], DISCOVERED)
    got = {r.domain: tuple(r)[1:] for r in update_discovered(known, found).collect()}
    assert got == {
        "x.example": ("x.example", 5, "2026-09-29", "2026-09-29", ["t9", "t8", "t7"]),
        "z.example": ("Z", 5, "2026-01-01", "2026-09-29", ["t3", "old"]),
        "q.example": ("Q", 1, "2026-01-01", "2026-01-01", []),
    }


def test_feed_run(spark, tmp_path):
    now = dt.datetime(2026, 9, 29, 12, tzinfo=dt.timezone.utc)
    entry = "<item><title>{}</title><link>https://a.example/{}</link><pubDate>Tue, 29 Sep 2026 10:00:00 +0000</pubDate></item>"
    titles = ["生成AIの新しい研究成果 & 公開", "宇宙ロケットの打上げ成功", "weather", "【PR】AIの広告"]
    body = "<rss><channel>" + "".join(entry.format(t.replace("&", "&amp;"), i) for i, t in enumerate(titles)) + "</channel></rss>"
    (tmp_path / "a.xml").write_text(body)
    (tmp_path / "sources.md").write_text(f"## RSS\n| 名前 | 言語 | RSS | 主なトピック |\n|---|---|---|---|\n| A | ja | {(tmp_path / 'a.xml').as_uri()} | 総合 |\n")
    topics = [{"name": "AI", "weight": 1.0, "allocation": 0.5, "keywords": ["AI", "生成AI"]}, {"name": "宇宙", "weight": 0.5, "allocation": 0.5, "keywords": ["宇宙"]}]
    (tmp_path / "profile.json").write_text(json.dumps({"topics": topics, "known_domains": [], "sources": []}))
    out = tmp_path / "out"
    out.mkdir()
    once = lambda at, dry=False: run.feed(spark, str(tmp_path / "profile.json"), str(tmp_path / "sources.md"), str(out), at, dry_run=dry, pause_s=0, wait_s=0)
    assert once(now, True) == 0 and not (out / "feed.xml").exists()
    assert once(now) == 0
    items = ET.parse(out / "feed.xml").getroot().findall("channel/item")
    assert {i.findtext("title") for i in items} == {"生成AIの新しい研究成果 & 公開", titles[1]}
    assert all("該当トピック" in i.findtext("description") and len(i.findtext("guid")) == 40 for i in items)
    assert "2件" in (out / "index.html").read_text()
    assert once(now + dt.timedelta(hours=1)) == 0  # the same stories again: seen, and carried on
    assert len(ET.parse(out / "feed.xml").getroot().findall("channel/item")) == 2
    (tmp_path / "a.xml").unlink()
    before = (out / "feed.xml").read_bytes()
    assert once(now + dt.timedelta(hours=2)) == 1 and (out / "feed.xml").read_bytes() == before


def test_profile_then_feed(spark, tmp_path):
    """A feed run on an own profile: a known medium's items are excluded, and what its feed shows isn't news from others either."""
    now = dt.datetime(2026, 9, 2, 12, tzinfo=dt.timezone.utc)
    entry = "<item><title>{}</title><link>{}</link><pubDate>Wed, 02 Sep 2026 10:00:00 +0000</pubDate></item>"
    feed = lambda *rows: "<rss><channel>" + "".join(entry.format(*r) for r in rows) + "</channel></rss>"
    (tmp_path / "known.xml").write_text(feed(("新型ロケットの打上げに成功", "https://www.a.example/9")))
    (tmp_path / "new.xml").write_text(feed(("新型ロケットの打上げに成功した", "https://n.example/1"), ("生成AIが医療の診断を変える", "https://n.example/2"), ("宇宙ステーションの新区画を公開", "https://sub.a.example/3")))
    known = (tmp_path / "known.xml").as_uri()
    rows = [(*r[:6], known if r[2] == "A" else "", *r[7:]) for r in history()]
    found = profile.build_profile(spark, spark.createDataFrame(rows, HISTORY), TOPICS, now=now)
    assert found["generated_at"] == "2026-09-02T12:00:00Z" and found["known_urls_count"] == len({r[3] for r in rows}) and "known_urls_count" not in found["stats"]
    assert {s["name"]: (s["known"], s["feed_url"]) for s in found["sources"]} == {"A": (True, known), "B": (True, ""), "C": (True, "")}
    write_profile(found, str(tmp_path))
    assert "| A |" in (tmp_path / "profile.md").read_text()
    (tmp_path / "sources.md").write_text(f"## RSS\n| 名前 | 言語 | RSS | 主なトピック |\n|---|---|---|---|\n| N | ja | {(tmp_path / 'new.xml').as_uri()} | 総合 |\n")
    out = tmp_path / "out"
    out.mkdir()
    assert run.feed(spark, str(tmp_path / "profile.json"), str(tmp_path / "sources.md"), str(out), now, least_score=0.01, pause_s=0, wait_s=0) == 0
    titles = [i.findtext("title") for i in ET.parse(out / "feed.xml").getroot().findall("channel/item")]
    assert titles == ["生成AIが医療の診断を変える"]


def test_streams(spark, tmp_path):
    at = dt.datetime(2026, 9, 29)
    rows = spark.createDataFrame([("https://a.example/1?utm_source=x", at), ("http://www.a.example/1", at), ("https://b.example/2", at)], "link string, published timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = []
    run_batches(fresh_once(stream), lambda df, _: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.link.split(".")[-2][-1] for r in got) == ["a", "b"]


def test_links_are_remembered_for_some_days(spark, tmp_path):
    """State by key over micro-batches: a link comes again once its timer has cleared it."""
    at = dt.datetime(2026, 9, 1)
    batches = [[("https://a.example/1", 0), ("http://www.a.example/1?utm_source=x", 1)], [("https://a.example/1", 3), ("https://b.example/2", 9)], [("https://c.example/3", 10)], [("https://a.example/1", 11), ("https://b.example/2", 11)]]
    for i, rows in enumerate(batches):
        days = [(link, at + dt.timedelta(days=d)) for link, d in rows]
        spark.createDataFrame(days, "link string, published timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("link string, published timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    with keyed_state(spark):
        run_batches(remembered(stream), lambda df, _: got.append(sorted((r.link, (r.published - at).days) for r in df.collect())), str(tmp_path / "state")).awaitTermination()
    assert [g for g in got if g] == [[("https://a.example/1", 0)], [("https://b.example/2", 9)], [("https://c.example/3", 10)], [("https://a.example/1", 11)]]
