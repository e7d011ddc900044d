"""Feeds: fetching them as a data source, and their entries as candidate items.

`FeedDataSource` reads a list of requests, one partition each; requests with a pause (a search service
that must not be hurried) share one partition and wait between each other. A failure becomes a row with
its error, so one feed never fails the rest. Everything after the bytes is DataFrame work.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.functions.text import detect_lang, plain, text_of, unescaped
from newsloom.functions.times import entry_time
from newsloom.functions.urls import domain_of
from newsloom.sources.config import Sources

# The services' addresses and parameters, the labels of the ways of collecting, limits.
GOOGLE_PARAMS = {"en": {"hl": "en-US", "gl": "US", "ceid": "US:en"}, "ja": {"hl": "ja", "gl": "JP", "ceid": "JP:ja"}}
VIA = {"rss": "RSS", "hatena": "はてブ検索", "google": "Googleニュース"}
SUMMARY_CHARS = 300
ERROR_CHARS = 120
TIMEOUT_S = 25
PAUSE_S = 1.0
AT_ONCE = 64
FINAL_CODES = (304, 403, 404, 410)
KINDS = ("rss", "hatena", "google")
REQUEST = "kind string, position int, label string, url string, name string, source_topics string"
FETCHED = REQUEST + ", body binary, error string"
ENTRY = ("title", "link", "summary", "published", "updated", "source_title", "source_href")
ENTRY_TAGS = ("item", "entry")
SAME_AS = {"description": "summary", "content": "summary", "pubdate": "published", "date": "published", "modified": "updated"}
CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.DOTALL)
PARSED = T.StructType([T.StructField("entries", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ENTRY]))), T.StructField("error", T.StringType())])
ITEM = "ord long, title string, link string, source string, via string, collector string, feed_url string, domain string, published timestamp, summary string, lang string, source_topics string"


def google_url(query: str, lang: str) -> str:
    return "https://news.google.com/rss/search?" + urllib.parse.urlencode({"q": f"{query} when:1d", **GOOGLE_PARAMS[lang]})


def hatena_url(query: str, min_users: int) -> str:
    return f"https://b.hatena.ne.jp/q/{urllib.parse.quote(query)}?" + urllib.parse.urlencode({"mode": "rss", "sort": "recent", "users": min_users})


def requests_of(sources: Sources) -> list[dict]:
    """What to fetch, in the order of the configuration."""
    rss = [("rss", s["name"], s["url"], s["name"], s["topics"]) for s in sources.rss]
    hatena = [("hatena", f"はてブ: {q['query']}", hatena_url(q["query"], q["min_users"]), "", "") for q in sources.hatena]
    google = [("google", f"Google: {q['query']}", google_url(q["query"], q["lang"]), "", "") for q in sources.google]
    names = ("kind", "label", "url", "name", "source_topics")
    return [dict(zip(names, r, strict=True), position=i) for part in (rss, hatena, google) for i, r in enumerate(part)]


def is_passing(error: Exception) -> bool:
    """Whether asking once more may help: anything but an answer that says it won't."""
    return isinstance(error, OSError) and getattr(error, "code", None) not in FINAL_CODES


def answer(url: str, headers: dict[str, str] | None = None, agent: str = "newsloom", attempts: int = 2, wait_s: float = 2.0) -> tuple[bytes, dict[str, str]]:
    """The body and the headers, by lower-case names."""
    request = urllib.request.Request(url, headers=headers or {})
    request.add_header("User-Agent", agent)
    request.add_header("Accept", "application/rss+xml, application/xml, */*")
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as response:
                return response.read(), {k.lower(): v for k, v in response.headers.items()}
        except Exception as e:
            if attempt == attempts or not is_passing(e):
                raise
        time.sleep(wait_s)
    raise ValueError("no attempt")


def fetch(url: str, agent: str = "newsloom", attempts: int = 2, wait_s: float = 2.0) -> bytes:
    return answer(url, None, agent, attempts, wait_s)[0]


class FeedReader(DataSourceReader):
    def __init__(self, requests: list[dict], pause_s: float, wait_s: float):
        self.requests, self.pause_s, self.wait_s = requests, pause_s, wait_s

    def partitions(self) -> list[InputPartition]:
        alone = [[r] for r in self.requests if r["kind"] != "google"]
        slow = [r for r in self.requests if r["kind"] == "google"]
        return [InputPartition(part) for part in [*alone, *([slow] if slow else [])]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, r in enumerate(partition.value):
            if i:
                time.sleep(self.pause_s)
            body, error = None, None
            try:
                body = fetch(r["url"], wait_s=self.wait_s)
            except Exception as e:  # reported as this request's status
                error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
            yield r["kind"], r["position"], r["label"], r["url"], r["name"], r["source_topics"], body, error


class FeedDataSource(DataSource):
    """Options: requests (JSON of requests_of), pause (seconds between searches), wait (before a second attempt)."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_feeds"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> FeedReader:
        return FeedReader(json.loads(self.options["requests"]), float(self.options.get("pause", PAUSE_S)), float(self.options.get("wait", 2.0)))


def fetched(spark: SparkSession, requests: list[dict], pause_s: float = PAUSE_S, wait_s: float = 2.0) -> DataFrame:
    spark.dataSource.register(FeedDataSource)
    return spark.read.format("newsloom_feeds").options(requests=json.dumps(requests), pause=pause_s, wait=wait_s).load()


Child = tuple[str, dict[str, str | None], str]  # name without namespace, attributes, text


def strict_children(body: bytes) -> Iterator[list[Child]]:
    """The children of each entry of a well-formed feed."""

    def local(e: ET.Element) -> str:
        return e.tag.rpartition("}")[2].lower()

    for entry in ET.fromstring(body).iter():
        if local(entry) in ENTRY_TAGS:
            yield [(local(child), dict(child.attrib), "".join(child.itertext())) for child in entry]


class LooseFeed(HTMLParser):
    """The same of what isn't well-formed: tags are taken as they come, an entry ends where the next one begins."""

    def __init__(self, body: bytes):
        super().__init__()
        self.entries: list[list[Child]] = []
        self.open: str | None = None
        declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w.-]+)", body)
        try:
            text = body.decode(declared[1].decode() if declared else "utf-8", "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        self.feed(CDATA.sub(lambda m: escape(m[1]), text))
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        tag = tag.rpartition(":")[2]
        if tag in ENTRY_TAGS:
            self.entries.append([])
            self.open = None
        elif self.entries and self.open is None:
            self.entries[-1].append((tag, dict(attrs), ""))
            self.open = tag

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = self.open
        self.handle_starttag(tag, attrs)
        self.open = before

    def handle_data(self, data: str) -> None:
        if self.open:
            tag, attrs, text = self.entries[-1][-1]
            self.entries[-1][-1] = tag, attrs, text + data

    def handle_endtag(self, tag: str) -> None:
        tag = tag.rpartition(":")[2]
        if tag == self.open or tag in ENTRY_TAGS:
            self.open = None


def entry_of(children: list[Child]) -> dict[str, str | None]:
    held: dict[str, str | None] = {}
    for tag, attributes, text in children:
        key = SAME_AS.get(tag, tag)
        if key == "source":
            held |= {"source_title": text.strip(), "source_href": attributes.get("url") or ""}
        elif key != "link" or not attributes.get("href"):
            held.setdefault(key, text.strip())
        elif (attributes.get("rel") or "alternate") == "alternate":
            held.setdefault("link", attributes["href"])
    return {name: held.get(name) for name in ENTRY}


def entries_of(body: bytes) -> list[dict]:
    """Entries of RSS 2.0, RDF or Atom; of a feed that isn't well-formed, those that can be told."""
    try:
        return [entry_of(children) for children in strict_children(body)]
    except ET.ParseError:
        found = [entry_of(children) for children in LooseFeed(body).entries]
        if not found:
            raise
        return found


def _parsed_slice(bodies: list[bytes | None]) -> pa.Array:
    held, errors, ends = {n: [] for n in ENTRY}, [], [0]
    for body in bodies:
        found, error = [], None
        try:
            found = entries_of(body) if body is not None else []
        except ET.ParseError as e:
            error = f"ParseError: {e}"[:ERROR_CHARS]
        for name, values in held.items():
            values += [e[name] for e in found]
        errors.append(error)
        ends.append(ends[-1] + len(found))
    entries = pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in held.values()], list(held))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries), pa.array(errors, pa.string())], ["entries", "error"])


@F.arrow_udf(PARSED)
def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A few bodies at a time, so that what is held as Python objects doesn't grow with a batch."""
    for bodies in batches:
        slices = [_parsed_slice(bodies.slice(at, AT_ONCE).to_pylist()) for at in range(0, len(bodies), AT_ONCE)]
        yield pa.concat_arrays(slices) if slices else _parsed_slice([])


def parsed(bodies: DataFrame) -> DataFrame:
    """FETCHED rows with their entries; `error` is that of fetching or of parsing."""
    found = bodies.withColumn("parsed", _parsed("body"))
    return found.select(*bodies.drop("body", "error").columns, F.coalesce("error", "parsed.error").alias("error"), F.coalesce("parsed.entries", F.array()).alias("entries"))


def statuses(feeds: DataFrame) -> DataFrame:
    return feeds.select("label", "kind", F.col("error").isNull().alias("ok"), F.size("entries").alias("count"), F.coalesce("error", F.lit("")).alias("error"))


def healthy(feeds: DataFrame, least_ratio: float = 0.5) -> bool:
    """Whether enough RSS feeds could be read; otherwise nothing should be published."""
    ok = feeds.where("kind = 'rss'").agg(F.avg(F.col("error").isNull().cast("double"))).first()[0]
    return (ok or 0.0) >= least_ratio


def _outside_link(link: Column, summary: Column, feed_url: Column) -> Column:
    """Of a feed of link summaries the first link that leads elsewhere."""
    links = F.filter(F.regexp_extract_all(summary, F.lit('href="([^"]+)"'), 1), lambda h: ~h.contains("techmeme.com"))
    return F.when(feed_url.contains("techmeme.com"), F.coalesce(unescaped(F.try_element_at(links, F.lit(1))), link)).otherwise(link)


def items(feeds: DataFrame) -> DataFrame:
    """ITEM rows of parsed feeds; ord follows kinds, configuration and entries."""
    rows = feeds.select("*", F.posexplode("entries").alias("at", "entry")).select("*", "entry.*").drop("entries", "entry")
    kind = F.col("kind")
    rows = rows.where((kind != "rss") | ((text_of("link") != "") & (text_of("title") != "")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind) * (1 << 52) + F.col("position").cast("long") * (1 << 30) + F.col("at")
    rows = rows.withColumns({"title": plain("title"), "publisher": text_of("source_title"), "ord": order, "link": _outside_link(text_of("link"), text_of("summary"), F.col("url"))})
    # a search result ends with its publisher; a portal's title ends with the publisher it copies
    ending = F.concat(F.lit(" - "), F.col("publisher"))
    cut = F.when((kind == "google") & (F.col("publisher") != "") & F.col("title").endswith(ending), F.left("title", F.length("title") - F.length(ending))).otherwise(F.col("title"))
    inner = F.regexp_extract("title", "（([^（）]{2,30})）$", 1)
    copied = (kind == "google") & F.lower("publisher").contains("yahoo") & (inner != "")
    rows = rows.withColumn("title", cut)
    rows = rows.withColumns({"publisher": F.when(copied, inner).otherwise(F.col("publisher")), "title": F.when(copied, F.rtrim(F.regexp_replace("title", "（[^（）]{2,30}）$", ""))).otherwise(F.col("title"))})
    domain = F.when(kind == "google", domain_of("source_href")).otherwise(domain_of("link"))
    via = F.element_at(F.create_map(*[F.lit(x) for kv in VIA.items() for x in kv]), kind)
    source = F.when(kind == "rss", F.col("name")).when(kind == "hatena", domain).otherwise(F.coalesce(F.nullif("publisher", F.lit("")), F.lit(VIA["google"])))
    summary = F.when(kind == "google", "").otherwise(F.left(plain("summary"), F.lit(SUMMARY_CHARS)))
    return rows.select(
        "ord", "title", "link", source.alias("source"), via.alias("via"), F.col("label").alias("collector"), F.col("url").alias("feed_url"), domain.alias("domain"),
        entry_time("published", "updated").alias("published"), summary.alias("summary"), detect_lang("title").alias("lang"), F.col("source_topics"),
    )


def known_source_titles(spark: SparkSession, profile_sources: list[dict], pause_s: float = PAUSE_S, wait_s: float = 2.0) -> DataFrame:
    """(link, title, ord) of the latest entries of the known sources that have a feed, in their order; failures give none."""
    wanted = [s for s in profile_sources if s.get("known") and s.get("feed_url")]
    requests = [{"kind": "rss", "position": i, "label": s["name"], "url": s["feed_url"], "name": s["name"], "source_topics": ""} for i, s in enumerate(wanted)]
    if not requests:
        return spark.createDataFrame([], "link string, title string, ord long")
    found = parsed(fetched(spark, requests, pause_s, wait_s)).select("position", F.posexplode("entries").alias("at", "e"))
    return found.select(text_of(F.col("e.link")).alias("link"), text_of(F.col("e.title")).alias("title"), (F.col("position").cast("long") * (1 << 30) + F.col("at")).alias("ord"))
