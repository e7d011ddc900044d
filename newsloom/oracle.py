"""DuckDB SQL for the queries; selections over page titles and whole feed runs have none and are tested against a sequential form."""

from __future__ import annotations

from newsloom.functions.text import STOP_WORDS
from newsloom.operators.exclusion import AD, AD_TITLE, BLOCKED as BLOCKED_REASON, COMPANY, ENGLISH, GALLERY, KNOWN
from newsloom.operators.matching import DEFAULT_WEIGHT, GAP, endings_of, is_cased, pieces_of
from newsloom.plans.profile import LEAST_READS
from newsloom.queries import BLOCKED, LANGUAGES, PROFILE, TOPICS, WIRE_DOMAINS, WIRE_PROFILE, WIRE_SOURCES, WIRE_TOPICS_OF_SOURCES
from newsloom.sources.config import Topic


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def condition(term: str, column: str = "text") -> str:
    if not term.isascii():
        return f"contains(lower({column}), {quoted(term.lower())})"
    said = f"{GAP.join(pieces_of(term))}({'|'.join(endings_of(term))})"
    return f"regexp_matches({column}, '(^|[^A-Za-z0-9]){said}([^A-Za-z0-9]|$)', '{'c' if is_cased(term) else 'i'}')"


def match_ctes(topics: list[Topic], rows: str = "documents", key: str = "doc_id", column: str = "text", weights: dict[str, dict[str, float]] = PROFILE.keyword_weights) -> str:
    """terms (a row per term) and hit (key, topic_ord, topic, pos, keyword, english, weight), exclusion applied."""
    values, met = [], []
    for order, t in enumerate(topics):
        for pos, (term, excludes) in enumerate([*((k, False) for k in t.terms), *((k, True) for k in t.exclude)]):
            weight = weights.get(t.name, {}).get(term, DEFAULT_WEIGHT)
            met.append(f"SELECT {key}, {len(values)} AS term FROM {rows} WHERE {condition(term, column)}")
            values.append(f"({len(values)}, {order}, {quoted(t.name)}, {pos}, {quoted(term)}, {excludes}, {term in t.english}, CAST({weight} AS DOUBLE))")
    return f"""terms(term, topic_ord, topic, pos, keyword, excludes, english, weight) AS (VALUES {', '.join(values)}),
met AS ({' UNION ALL '.join(met)}),
allhits AS (SELECT met.{key}, terms.*, bool_or(excludes) OVER (PARTITION BY met.{key}, topic_ord) AS vetoed FROM met JOIN terms ON met.term = terms.term),
hit AS (SELECT * FROM allhits WHERE NOT vetoed AND NOT excludes)"""


TOPIC_ROWS = ", ".join(f"({i}, {quoted(t.name)}, {t.collect}, CAST({t.multiplier} AS DOUBLE))" for i, t in enumerate(TOPICS))
DATED = "dated AS (SELECT *, doc_id % 400 AS age, pow(0.5, (doc_id % 400) / 180.0) AS w, doc_id % 400 <= 90 AS recent FROM documents)"
TOTALS = "totals AS (SELECT sum(w) AS w, greatest(count(*) FILTER (WHERE recent), 1) AS recent, greatest(count(*) FILTER (WHERE NOT recent), 1) AS older FROM dated)"
SHARES = f"""topics(topic_ord, topic, collect, multiplier) AS (VALUES {TOPIC_ROWS}), {DATED}, {TOTALS},
per AS (SELECT topic_ord, sum(w) AS w, count(*) AS n, count(*) FILTER (WHERE recent) AS recent FROM (SELECT DISTINCT doc_id, topic_ord FROM hit) h JOIN dated USING (doc_id) GROUP BY 1),
rates AS (SELECT topics.*, round(coalesce(per.w, 0) / totals.w, 4) AS share, coalesce(n, 0) AS n, coalesce(per.recent, 0) / totals.recent AS rr, (coalesce(n, 0) - coalesce(per.recent, 0)) / totals.older AS o
  FROM topics LEFT JOIN per ON topics.topic_ord = per.topic_ord, totals)"""


def trend(recent: str, older: str) -> str:
    return f"CASE WHEN {older} = 0 AND {recent} > 0 THEN '新規' WHEN {older} = 0 THEN '—' WHEN {recent} / {older} >= 1.3 THEN '↑ 増加' WHEN {recent} / {older} <= 0.77 THEN '↓ 減少' ELSE '→ 横ばい' END"


TOKENS = f"""tok AS (SELECT DISTINCT doc_id, w FROM (
  SELECT doc_id, CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-.]*[a-z0-9]|[a-z0-9]')) AS x FROM documents))
  WHERE length(w) > 1 AND w NOT IN ({', '.join(map(quoted, STOP_WORDS))}))"""
IDF = "n AS (SELECT greatest(count(*), 1) AS n FROM documents), idf AS (SELECT w, count(*) AS df, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM tok, n GROUP BY w)"
CLASSES = "sets AS (SELECT d.doc_id, coalesce(t.ws, []) AS ws FROM documents d LEFT JOIN (SELECT doc_id, list_sort(list(w)) AS ws FROM tok GROUP BY 1) t ON d.doc_id = t.doc_id)"
HOST = "regexp_replace(regexp_extract(lower({0}), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')"
NORMAL_URL = """'https://' || regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
  CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END"""
NORMALISED = f"""pairs AS (SELECT *, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '=.') AND NOT regexp_matches(p, '^(utm_|fbclid|gclid|ref=|ref_|cmpid|ncid|sr_share)')) AS kept FROM pages),
normal AS (SELECT page_id, url, {NORMAL_URL} AS n FROM pairs)"""
READS = f"reads AS (SELECT page_id, url, {HOST.format('url')} AS domain, regexp_extract({HOST.format('url')}, '^([^.]+)', 1) AS source FROM pages)"
KNOWN_SOURCES = f"known AS (SELECT source FROM reads GROUP BY 1 HAVING count(*) >= {LEAST_READS})"
UNESCAPE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
TITLE = UNESCAPE.format("regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g')")
TITLE_TOKENS = f"headlines AS (SELECT page_id AS doc_id, {TITLE} AS text FROM pages), " + f"{TOKENS}, {IDF}, {CLASSES}".replace("documents", "headlines")
SPAM = [Topic("spam", ["cheap", "pills", "farm"]), Topic("ththe", ["that"])]
TITLED = "titled AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url FROM pages)"
VIA = "CASE doc_id % 3 WHEN 0 THEN 'RSS' WHEN 1 THEN 'はてブ検索' ELSE 'Googleニュース' END"
MONEY = next(t for t in TOPICS if not t.collect)
REASON = f"""SELECT doc_id, CASE WHEN source = 'src1' OR (doc_id % 3 <> 0 AND source LIKE 'src2%') THEN '{KNOWN}' WHEN lang NOT IN ({', '.join(map(quoted, LANGUAGES))}) THEN '{ENGLISH}'
  WHEN regexp_matches(text, '{AD_TITLE}') THEN '{AD}' WHEN regexp_matches(text, '^【画像】|\\s\\d+/\\d+\\n?$') THEN '{GALLERY}' WHEN source IN ('src3', 'src4') THEN '{BLOCKED_REASON}'
  WHEN {' OR '.join(condition(k) for k in MONEY.terms)} THEN '集めない話題（{MONEY.name}）' ELSE '' END AS reason FROM documents"""
assert BLOCKED == ["src3", "src4.example.com"]
WEIGHTS = ", ".join(f"({quoted(k)}, CAST({v} AS DOUBLE))" for k, v in PROFILE.weights.items())
MEDIA = f"media AS (SELECT page_id, url, page_id % 2 AS run, {HOST.format('url')} AS domain, strftime(DATE '2024-01-31' + CAST(page_id % 5 AS INTEGER), '%Y-%m-%d') AS day FROM pages WHERE {HOST.format('url')} NOT IN ('', 'example.com'))"
PART_TOKENS = f"parts AS (SELECT p_partkey AS doc_id, p_name AS text FROM part), {TOKENS}, {IDF}, {CLASSES}".replace("documents", "parts")
PAIRS = """reps AS (SELECT min(doc_id) AS doc_id FROM sets WHERE len(ws) > 0 GROUP BY ws),
held AS (SELECT doc_id, w, idf FROM tok JOIN reps USING (doc_id) JOIN idf USING (w)), total AS (SELECT doc_id, sum(idf) AS s FROM held GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.idf) AS s FROM held a JOIN held b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2),
sims AS (SELECT a, b, round(shared.s / (x.s + y.s - shared.s), 12) AS sim FROM shared JOIN total x ON a = x.doc_id JOIN total y ON b = y.doc_id)"""
PART_PAIRS, TITLE_PAIRS = f"{PART_TOKENS}, {PAIRS}", f"{TITLE_TOKENS}, {PAIRS}"

SAVED = """saved AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS read_rank, 'T ' || o_orderstatus || ' ' || o_orderkey AS title, 'S & ' || o_orderpriority AS source,
  'https://e.example/?a=1&o=' || o_orderkey AS url, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T04:15:16Z' END AS published,
  CASE WHEN o_orderkey % 5 = 0 THEN strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') || 'T23:00:00Z' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T13:00:00Z' END AS received, 'http://f.example/' || o_orderkey AS feed_url,
  'm ' || o_orderkey % 3 AS feedly_meme, 'about ' || o_orderkey AS summary, 'o' || o_orderkey AS entry_id, CASE WHEN o_orderkey % 5 = 0 THEN 'published' ELSE '' END AS lacks FROM orders)"""


def stories_sql(pairs: str, name: str) -> str:
    """Leaders in the order of their ids, one after the other, and each row's most similar one."""
    return f"""WITH RECURSIVE {pairs}, near AS (SELECT * FROM sims WHERE sim >= 0.3),
numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM reps), before AS (SELECT numbered.doc_id, i, coalesce(list(a) FILTER (WHERE a IS NOT NULL), []) AS earlier FROM numbered LEFT JOIN near ON doc_id = b GROUP BY 1, 2),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders UNION ALL
  SELECT before.i, CASE WHEN list_has_any(leaders, earlier) THEN leaders ELSE list_append(leaders, doc_id) END FROM walk JOIN before ON before.i = walk.i + 1),
leads AS (SELECT unnest(leaders) AS leader FROM walk WHERE i = (SELECT count(*) FROM reps)),
mutual AS (SELECT a, b, sim FROM near UNION ALL SELECT b, a, sim FROM near UNION ALL SELECT doc_id, doc_id, 1.0 FROM reps),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ws) AS c FROM sets)
SELECT doc_id AS {name}, story FROM (SELECT class.doc_id, leader AS story, row_number() OVER (PARTITION BY class.doc_id ORDER BY sim DESC, leader DESC) AS place FROM class JOIN mutual ON a = c JOIN leads ON leader = b AND leader <= class.doc_id) WHERE place = 1
UNION ALL SELECT doc_id, doc_id FROM sets WHERE len(ws) = 0"""



def one_of(values: list, number: str = "k") -> str:
    return f"list_extract([{', '.join(quoted(v) for v in values)}], CAST({number} % {len(values)} + 1 AS INTEGER))"


WIRE = f"""wire AS (SELECT k, {one_of(['【PR】', '[PR] ', '【画像】', 'Sponsored ', *[''] * 7])} AS before, {one_of([' 3/12', ' cheap', ' old', *[''] * 10])} AS after, {one_of(WIRE_SOURCES)} AS source, {one_of(['RSS', 'はてブ検索', 'Googleニュース'])} AS via,
  {one_of(WIRE_DOMAINS)} AS domain, {one_of(['cheap casino', 'a red ring', 'pills', 'hot hot bolts', *[''] * 15])} AS summary, {one_of(['ja', 'en', 'en', 'fr', 'en', 'en'])} AS lang, {one_of(WIRE_TOPICS_OF_SOURCES)} AS source_topics,
  CASE WHEN k % 17 <> 0 THEN k % 100 - 3 END AS age, before || p_name || after AS title FROM (SELECT p_partkey AS k, p_name FROM part))"""


def met_in(column: str) -> str:
    return f"(WITH {match_ctes(WIRE_PROFILE.topics, 'wire', 'k', column, WIRE_PROFILE.keyword_weights)} SELECT DISTINCT k, topic_ord, topic, pos, keyword, weight FROM hit)"


SPECIAL = " UNION ALL ".join(f"SELECT k, {i} AS topic_ord, {quoted(t)} AS topic, source FROM wire WHERE source_topics = {quoted(said)}" for i, t, said in ((1, "metal・rings", "rings、x"), (2, "sizes", "sizes・ほか")))
WIRE_WEIGHTS = ", ".join(f"({quoted(t)}, CAST({w} AS DOUBLE))" for t, w in WIRE_PROFILE.weights.items())

ORACLE_SQL: dict[str, str] = {
    "topic_match": f"WITH {match_ctes(TOPICS)} SELECT doc_id, topic, string_agg(keyword, ',' ORDER BY pos) AS keywords FROM hit GROUP BY doc_id, topic",
    "topic_share": f"WITH {match_ctes(TOPICS)}, {SHARES} SELECT topic, share, n, round(rr, 4) AS recent_rate, round(o, 4) AS older_rate, {trend('rr', 'o')} AS trend FROM rates",
    "topic_weights_alloc": f"""WITH {match_ctes(TOPICS)}, {SHARES},
based AS (SELECT *, CASE WHEN share > 0 AND collect THEN round(sqrt(share / (SELECT max(share) FROM rates WHERE collect)), 3) ELSE 0.0 END AS base_weight FROM rates),
raw AS (SELECT *, base_weight * multiplier AS raw FROM based)
SELECT topic, base_weight, round(raw / (SELECT max(raw) FROM raw WHERE collect), 3) AS weight, round(raw / (SELECT sum(raw) FROM raw WHERE collect), 4) AS allocation FROM raw""",
    "keyword_weights": f"""WITH {match_ctes(TOPICS)}, {DATED},
seen AS (SELECT term, sum(w) AS observed, count(*) AS n FROM hit JOIN dated USING (doc_id) GROUP BY term),
defined AS (SELECT terms.*, coalesce(observed, 0) AS observed, coalesce(n, 0) AS n FROM terms LEFT JOIN seen ON terms.term = seen.term WHERE NOT excludes)
SELECT topic, keyword AS term, round(observed, 2) AS weighted, n, CASE WHEN observed > 0 THEN round(0.4 + 0.6 * ln(1 + observed) / ln(1 + max(observed) OVER (PARTITION BY topic)), 3) WHEN english THEN 0.7 ELSE 0.4 END AS keyword_weight FROM defined""",
    "topic_samples": f"""WITH {match_ctes(TOPICS)}, placed AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS place FROM (SELECT DISTINCT topic, doc_id FROM hit))
SELECT topic, doc_id, CAST(place AS INTEGER) AS place, source FROM placed JOIN documents USING (doc_id) WHERE place <= 5""",
    "quota_largest_remainder": """WITH s AS (SELECT o_orderpriority AS name, count(*) / sum(count(*)) OVER () * 32 AS raw FROM orders GROUP BY 1),
r AS (SELECT name, floor(raw) AS whole, row_number() OVER (ORDER BY raw - floor(raw) DESC, name) AS k, 32 - sum(floor(raw)) OVER () AS spare FROM s)
SELECT name, CAST(whole + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""",
    "est_read_running_max": "SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS greatest FROM events",
    "source_table": f"""WITH {READS}, d AS (SELECT source, domain, count(*) AS n, min(page_id) AS first FROM reads GROUP BY 1, 2),
m AS (SELECT source, domain, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS k FROM d)
SELECT reads.source, count(*) AS n, round(count(*) / (SELECT count(*) FROM reads), 4) AS share, any_value(m.domain) AS domain, count(*) >= {LEAST_READS} AS known FROM reads JOIN m ON reads.source = m.source AND k = 1 GROUP BY 1""",
    "source_known_domains": f"WITH {READS}, {KNOWN_SOURCES} SELECT DISTINCT domain FROM (SELECT source, domain, count(*) AS n FROM reads GROUP BY 1, 2) JOIN known USING (source) WHERE n >= {LEAST_READS}",
    "trend_rising": f"""WITH {TOKENS}, {DATED}, {TOTALS}, t AS (SELECT w AS term, count(*) AS n, count(*) FILTER (WHERE recent) AS recent, count(*) FILTER (WHERE NOT recent) AS older FROM (SELECT tok.w, recent FROM tok JOIN dated USING (doc_id)) GROUP BY 1)
SELECT term, t.recent, t.older, round((t.recent / totals.recent) / greatest(t.older / totals.older, 1e-9), 1) AS ratio FROM t, totals
WHERE n >= 8 AND t.recent >= 5 AND t.recent / totals.recent > 1.2 * (t.older / totals.older) AND term NOT IN ({', '.join(quoted(k.lower()) for t in TOPICS for k in t.terms)})""",
    "trend_labels": f"""WITH r AS (SELECT user_id, avg(CAST(ts >= TIMESTAMP '2024-01-20' AS DOUBLE)) AS r, avg(CAST(ts < TIMESTAMP '2024-01-05' AS DOUBLE)) AS o FROM events GROUP BY 1)
SELECT user_id, {trend('r', 'o')} AS trend FROM r""",
    "top_terms": f"""WITH {TOKENS}, {DATED} SELECT tok.w AS term, round(sum(d.w), 6) AS weighted, count(*) AS n, count(*) FILTER (WHERE recent) AS recent, count(*) FILTER (WHERE NOT recent) AS older
FROM tok JOIN dated d USING (doc_id) GROUP BY 1 ORDER BY n DESC, term LIMIT 60""",
    "profile_stats": f"""WITH {match_ctes([t for t in TOPICS if t.collect])}, d AS (SELECT *, doc_id % 400 AS age, strftime(DATE '2024-01-31' - CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS day FROM documents)
SELECT count(*) AS articles, min(day) AS published_min, max(day) AS published_max, min(day) FILTER (WHERE age <= 300) AS est_read_min_main,
count(*) FILTER (WHERE regexp_matches(text, '[぀-ヿ一-鿿]')) AS japanese_titles, count(*) FILTER (WHERE NOT regexp_matches(text, '[぀-ヿ一-鿿]')) AS other_titles,
(SELECT count(DISTINCT doc_id) FROM hit) AS matched_any_topic, count(*) FILTER (WHERE age > 300) AS old_items,
coalesce(array_to_string(list_sort(list(DISTINCT left(day, 4)) FILTER (WHERE age > 300)), ','), '') AS old_items_published_years, count(DISTINCT source || '/' || doc_id) AS known_urls_count FROM d""",
    "url_normalize": f"WITH {NORMALISED} SELECT page_id, n AS url, {HOST.format('url')} AS domain FROM normal",
    "seen_urls": f"WITH {NORMALISED} SELECT page_id, url AS link FROM normal WHERE page_id % 2 = 1 AND n NOT IN (SELECT n FROM normal WHERE page_id % 2 = 0)",
    "page_extract": f"""SELECT page_id, {TITLE} AS title,
{UNESCAPE.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')")} AS article FROM pages""",
    "saved_dates": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS saved, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS feed FROM events",
    "name_and_language": "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS name, CASE WHEN regexp_matches(p_name, '[぀-ヿ一-鿿]') THEN 'ja' ELSE 'en' END AS lang FROM part",
    "exclusion_reason": REASON,
    "profile_exclusion": f"""WITH {READS}, {KNOWN_SOURCES}, kd AS (SELECT DISTINCT domain FROM (SELECT source, domain, count(*) AS n FROM reads GROUP BY 1, 2) JOIN known USING (source) WHERE n >= {LEAST_READS}),
at_domain AS (SELECT DISTINCT page_id FROM reads JOIN kd ON reads.domain = kd.domain OR ends_with(reads.domain, '.' || kd.domain)),
at_name AS (SELECT DISTINCT page_id FROM reads JOIN known ON length(known.source) >= 3 AND length(domain) >= 3 AND (starts_with(domain, lower(known.source)) OR starts_with(lower(known.source), domain)) WHERE page_id % 3 <> 0)
SELECT page_id, page_id IN (SELECT page_id FROM at_domain) OR page_id IN (SELECT page_id FROM at_name) AS known FROM reads""",
    "exclusion_counts": f"SELECT reason, count(*) AS n FROM ({REASON}) GROUP BY 1",
    "domain_list": f"SELECT page_id FROM pages WHERE regexp_matches({HOST.format('url')}, '(^|\\.)(example\\.com|ththth\\.example\\.net)$')",
    "publisher_prefixes": """SELECT DISTINCT p_name AS name FROM (SELECT p_name, lower(replace(p_name, ' ', '')) AS n FROM part), (VALUES ('smallr'), ('redwidgetnews')) k(k)
WHERE length(n) >= 3 AND (starts_with(n, k) OR starts_with(k, n))""",
    "veto_filter": f"""WITH {TITLED}, m AS (SELECT page_id, CASE WHEN {' OR '.join(condition(k, 'title') for k in SPAM[0].terms)} OR {' + '.join(f"CAST({condition(k, 'url')} AS INTEGER)" for k in SPAM[0].terms)} >= 2 THEN 'spam'
WHEN {condition('that', 'title')} THEN 'ththe' END AS veto FROM titled) SELECT page_id, veto FROM m WHERE veto IS NOT NULL""",
    "relevance_scores": f"""WITH {match_ctes(PROFILE.topics)}, weights(topic, tw) AS (VALUES {WEIGHTS}),
rel AS (SELECT doc_id, hit.topic, coalesce(tw, 0.5) AS tw, 1 - product(1 - weight) AS rel FROM hit LEFT JOIN weights ON hit.topic = weights.topic GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(rel, 3) DESC, tw, topic DESC) AS k FROM rel),
per AS (SELECT doc_id, sum(tw * rel) AS total, count(*) AS n FROM rel GROUP BY 1)
SELECT d.doc_id, coalesce(round(total * pow(0.5, (d.doc_id % 80) / 72.0) * CASE WHEN d.doc_id % 3 = 2 THEN 0.85 ELSE 1.0 END, 4), 0.0) AS score, coalesce(best.topic, '') AS primary, CAST(coalesce(n, 0) AS INTEGER) AS n_topics
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN best ON d.doc_id = best.doc_id AND k = 1""",
    "idf": f"WITH {TOKENS}, {IDF} SELECT w AS token, df, round(idf, 9) AS idf FROM idf",
    "story_classes": f"WITH {TITLE_TOKENS} SELECT doc_id AS page_id, min(doc_id) OVER (PARTITION BY ws) AS class_id FROM sets",
    "story_pairs": f"""WITH {TITLE_TOKENS}, reps AS (SELECT min(doc_id) AS doc_id FROM sets WHERE len(ws) > 0 GROUP BY ws),
held AS (SELECT doc_id, w, idf FROM tok JOIN reps USING (doc_id) JOIN idf USING (w)), total AS (SELECT doc_id, sum(idf) AS s FROM held GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.idf) AS s FROM held a JOIN held b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(sim, 6) AS similarity FROM (SELECT a, b, shared.s / (x.s + y.s - shared.s) AS sim FROM shared JOIN total x ON a = x.doc_id JOIN total y ON b = y.doc_id) WHERE round(sim, 12) >= 0.3""",
    "rep_swap": """WITH r AS (SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS story, o_orderkey AS ord, o_orderpriority AS source, o_orderstatus = 'F' AS rss, o_totalprice AS score FROM orders),
l AS (SELECT story, rss AS lrss, score AS lscore FROM r WHERE ord = story),
p AS (SELECT r.story, coalesce(min(ord) FILTER (WHERE NOT lrss AND rss AND score >= 0.8 * lscore), r.story) AS rep FROM r JOIN l ON r.story = l.story GROUP BY r.story),
o AS (SELECT p.story, p.rep, r.source FROM p JOIN r ON p.rep = r.ord),
x AS (SELECT o.story, o.rep, list_sort(list(DISTINCT r.source) FILTER (WHERE r.source <> o.source)) AS rel FROM o JOIN r ON o.story = r.story GROUP BY 1, 2)
SELECT story, rep, coalesce(array_to_string(rel, ','), '') AS related, CAST(round(1 + 0.08 * least(coalesce(len(rel), 0), 10), 2) AS DOUBLE) AS buzz FROM x""",
    "quota_cap_topk": """SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(place AS INTEGER) AS place FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 4""",
    "discovered_upsert": f"""WITH {MEDIA}, e AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY run DESC, page_id DESC) AS k FROM media),
ex AS (SELECT domain, string_agg(url, ' ' ORDER BY k) AS examples FROM e WHERE k <= 3 GROUP BY 1)
SELECT m.domain, m.domain AS publisher, count(*) AS n, arg_min(day, run * 1000000000 + page_id) AS first_seen, arg_max(day, run * 1000000000 + page_id) AS last_seen, any_value(examples) AS examples
FROM media m JOIN ex ON m.domain = ex.domain GROUP BY 1""",
    "retention_seen": "SELECT event_id, user_id FROM events WHERE epoch(TIMESTAMP '2024-01-30') - epoch(ts) < 604800",
    "day_groups": "SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n, round(max(value), 2) AS best FROM events GROUP BY 1",
    "collector_gate": "SELECT r / 100.0::DOUBLE AS least_ratio, (SELECT avg(CAST(event_type <> 'error' AS DOUBLE)) FROM events WHERE user_id % 10 <> 0) >= r / 100.0::DOUBLE AS healthy FROM range(0, 101, 5) t(r)",
    "feed_descriptions": f"""WITH {match_ctes(TOPICS)}, t AS (SELECT doc_id, topic_ord, topic || '（' || string_agg(keyword, ', ' ORDER BY pos) FILTER (WHERE k <= 4) || '）' AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, topic_ord ORDER BY pos) AS k FROM hit) GROUP BY doc_id, topic_ord, topic),
d AS (SELECT doc_id, string_agg(part, ' / ' ORDER BY topic_ord) AS parts FROM t GROUP BY 1)
SELECT d.doc_id, '該当トピック: ' || parts || '｜出典: ' || source || CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE '・' || {VIA.replace('doc_id', 'd.doc_id')} || '経由' END || '｜同じ話題: 他2媒体（x、y）｜スコア ' || printf('%.2f', d.doc_id / 10.0) AS description,
sha1('https://' || source || '.example.com/' || d.doc_id) AS guid FROM d JOIN documents ON d.doc_id = documents.doc_id""",
    "exact_rounding": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"CAST(printf('%.{n}f', CAST(l_extendedprice AS DOUBLE) / 2000) AS DOUBLE) AS d{n}" for n in (1, 2, 3, 4))
    + " FROM lineitem",
    "processing_order": "SELECT o_orderkey, '1' || printf('%012X', CAST(1000000000000 - round(round(o_totalprice / 1e6, 4) * 10000) AS BIGINT)) || printf('%016X', o_orderkey) AS key FROM orders",
    "stream_domain_counts": f"SELECT strftime(TIMESTAMP '2024-01-31' - to_minutes(page_id), '%Y-%m-%d') AS day, {HOST.format('url')} AS domain, count(*) AS n FROM pages GROUP BY 1, 2",
    "part_pairs": f"WITH {PART_PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM sims WHERE sim >= 0.3",
    "part_stories": stories_sql(PART_PAIRS, "p_partkey"),
    "story_clusters": stories_sql(TITLE_PAIRS, "page_id"),
    "part_picks": f"""WITH RECURSIVE {PART_TOKENS}, cand AS (SELECT p_partkey AS ord, 'source' || p_partkey % 9 AS src, round(p_retailprice, 1) AS score, CASE p_brand WHEN 'Brand#1' THEN 'a' WHEN 'Brand#2' THEN 'b' ELSE '' END AS topic, round(p_size / 100.0, 2) AS rank, ws FROM part JOIN sets ON p_partkey = doc_id),
weight AS (SELECT map(list(w), list(idf)) AS m FROM idf),
turn AS (SELECT row_number() OVER (ORDER BY phase, rank DESC, score DESC, ord) AS i, * FROM (SELECT CASE topic WHEN 'a' THEN 1 ELSE 2 END AS phase, CASE topic WHEN 'a' THEN 7 ELSE 3 END AS quota, * FROM cand WHERE topic <> '' UNION ALL SELECT 3, 12, ord, src, score, topic, 0.0, ws FROM cand)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ords, CAST([] AS VARCHAR[]) AS srcs, CAST([] AS VARCHAR[][]) AS words, 0 AS phase, 0 AS got UNION ALL
  SELECT i, CASE WHEN take THEN list_append(ords, ord) ELSE ords END, CASE WHEN take THEN list_append(srcs, src) ELSE srcs END, CASE WHEN take THEN list_append(words, ws) ELSE words END, phase, got + CAST(take AS INTEGER)
  FROM (SELECT turn.i, turn.phase, ords, srcs, words, ord, src, ws, CASE WHEN walk.phase = turn.phase THEN got WHEN turn.phase = 3 THEN len(ords) ELSE 0 END AS got,
      CASE WHEN walk.phase = turn.phase THEN got WHEN turn.phase = 3 THEN len(ords) ELSE 0 END < quota AND NOT list_contains(ords, ord) AND len(list_filter(srcs, lambda x: x = src)) < 2
      AND NOT list_bool_or(list_transform(words, lambda o: round(coalesce(list_sum(list_transform(list_intersect(o, ws), lambda t: m[t])), 0) / list_sum(list_transform(list_distinct(list_concat(o, ws)), lambda t: m[t])), 12) >= 0.5)) IS TRUE AS take
    FROM walk JOIN turn ON turn.i = walk.i + 1, weight))
SELECT ord AS p_partkey, CAST(p - 1 AS BIGINT) AS place FROM (SELECT unnest(ords) AS ord, generate_subscripts(ords, 1) AS p FROM walk WHERE i = (SELECT max(i) FROM turn))""",
    "wire_reasons": f"""WITH {WIRE} SELECT k AS p_partkey, CASE WHEN age > 72 THEN 'too_old'
WHEN domain IN ('src1.example.com', 'a.src1.example.com') OR (via <> 'RSS' AND source = 'src2 news') THEN '{KNOWN}' WHEN lang NOT IN ({', '.join(map(quoted, LANGUAGES))}) THEN '{ENGLISH}'
WHEN before IN ('【PR】', '[PR] ', 'Sponsored ') THEN '{AD}' WHEN before = '【画像】' OR after = ' 3/12' THEN '{GALLERY}' WHEN via = 'Googleニュース' AND source IN ('株式会社 北', '合同会社 南') THEN '{COMPANY}'
WHEN source = 'src3' OR domain IN ('src4.example.com', 'sub.src4.example.com') THEN '{BLOCKED_REASON}' WHEN after = ' cheap' OR summary = 'cheap casino' THEN '集めない話題（money）' ELSE '' END AS reason FROM wire""",
    "wire_scores": f"""WITH {WIRE}, th AS {met_in('title')}, sh0 AS {met_in('summary')}, sp AS ({SPECIAL}),
sh AS (SELECT * FROM sh0 WHERE NOT EXISTS (SELECT 1 FROM th WHERE th.k = sh0.k AND th.topic_ord = sh0.topic_ord AND th.keyword = sh0.keyword)),
t AS (SELECT DISTINCT k, topic_ord, topic FROM (SELECT k, topic_ord, topic FROM th UNION ALL SELECT k, topic_ord, topic FROM sh0 UNION ALL SELECT k, topic_ord, topic FROM sp)),
tt AS (SELECT k, topic_ord, product(1 - weight) AS p, string_agg(keyword, '+' ORDER BY pos) AS ks FROM th GROUP BY 1, 2), st AS (SELECT k, topic_ord, product(1 - 0.5 * weight) AS p, string_agg(keyword, '+' ORDER BY pos) AS ks FROM sh GROUP BY 1, 2),
w(topic, tw) AS (VALUES {WIRE_WEIGHTS}),
x AS (SELECT t.*, coalesce(tw, 0.5) AS tw, CASE WHEN sp.source IS NOT NULL AND tt.p IS NULL THEN 0.5 ELSE 1.0 END * coalesce(tt.p, 1.0) AS title_left, coalesce(st.p, 1.0) AS sum_left, sp.source, coalesce(concat_ws('+', tt.ks, st.ks), '') AS ks
  FROM t LEFT JOIN tt ON t.k = tt.k AND t.topic_ord = tt.topic_ord LEFT JOIN st ON t.k = st.k AND t.topic_ord = st.topic_ord LEFT JOIN sp ON t.k = sp.k AND t.topic_ord = sp.topic_ord LEFT JOIN w ON t.topic = w.topic),
c AS (SELECT *, tw * (1 - title_left * sum_left) * CASE WHEN source IS NULL THEN 1.0 ELSE 1.5 END AS con, CASE WHEN ks = '' THEN '専門媒体: ' || source ELSE ks END AS said FROM x),
per AS (SELECT k, sum(con) AS total, string_agg(topic || ':' || said, ' ' ORDER BY round(con, 3) DESC, topic_ord) AS topics FROM c GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(1 - title_left, 3) DESC, round(1 - title_left * sum_left, 3) DESC, tw, topic DESC) AS place FROM c)
SELECT wire.k AS p_partkey, coalesce(round(total * pow(0.5, greatest(coalesce(age, 0), 0) / 72.0) * CASE WHEN via = 'Googleニュース' THEN 0.85 ELSE 1.0 END, 4), 0.0) AS score,
CASE WHEN title_left < 1 THEN best.topic ELSE '' END AS primary, coalesce(per.topics, '') AS topics, CASE WHEN title_left < 1 THEN round(con, 3) ELSE 0.0 END AS contrib FROM wire LEFT JOIN per ON wire.k = per.k LEFT JOIN best ON wire.k = best.k AND place = 1""",
    "saved_articles": f"WITH {SAVED} SELECT * FROM saved",
    "saved_report": f"WITH {SAVED} SELECT count(*) AS articles, min(nullif(published, '')) AS published_min, max(nullif(published, '')) AS published_max, count(*) FILTER (WHERE lacks <> '') AS problems FROM saved",
    "feed_entries": """WITH e AS (SELECT *, o_custkey % 2 = 0 AS atom, o_custkey % 3 AS kind, 'T & ' || o_orderpriority AS head, o_orderkey % 2 = 0 AS signed FROM orders),
l AS (SELECT *, CASE WHEN atom THEN 'https://a.example/' ELSE 'https://www.h' || o_orderkey % 7 || '.example/' END || o_orderkey AS link, CASE WHEN atom THEN 'a.example' ELSE 'h' || o_orderkey % 7 || '.example' END AS site FROM e)
SELECT CASE WHEN signed AND NOT (kind = 2 AND NOT atom AND FALSE) THEN head || ' - The Post' ELSE head END AS title, link, CASE kind WHEN 0 THEN 'N' || o_custkey WHEN 1 THEN site WHEN 2 THEN CASE WHEN atom THEN 'Googleニュース' ELSE 'The <b>Post' END END AS source,
CASE kind WHEN 0 THEN 'RSS' WHEN 1 THEN 'はてブ検索' ELSE 'Googleニュース' END AS via, 'L' || o_custkey AS collector, CASE WHEN kind < 2 THEN site WHEN atom THEN '' ELSE 'post.example' END AS domain,
CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) + CASE WHEN atom THEN 0 ELSE 15 * 3600 END AS published, CASE WHEN kind = 2 THEN '' WHEN atom THEN 's' ELSE 'order ' || o_orderkey END AS summary, 'en' AS lang FROM l""",
    "feed_statuses": """SELECT 'L' || o_custkey AS label, CASE o_custkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'hatena' ELSE 'google' END AS kind, o_custkey % 11 <> 0 AND o_custkey % 13 <> 0 AS ok,
CAST(CASE WHEN o_custkey % 11 <> 0 AND o_custkey % 13 <> 0 THEN count(*) ELSE 0 END AS INTEGER) AS n, CASE WHEN o_custkey % 13 = 0 THEN 'HTTPError' WHEN o_custkey % 11 = 0 THEN 'ParseError' ELSE '' END AS error FROM orders GROUP BY o_custkey""",
    "configured_topics": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)
SELECT r_name AS topic, string_agg(n_name, ',' ORDER BY k % 2, k) AS terms, CAST(1 + r_regionkey / 4 AS DOUBLE) AS multiplier, r_regionkey <> 3 AS collect FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""",
    "configured_sources": """SELECT 'rss' AS section, n_name AS name, 'https://n.example/' || n_nationkey AS value FROM nation UNION ALL SELECT 'hatena', n_name, CAST(n_nationkey * 3 AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT 'blocked', n_name, '' FROM nation WHERE n_nationkey % 5 = 0""",
    "published_feed": """SELECT 'News ' || n_name AS title, 'https://n.example/?a=1&n=' || n_nationkey AS link, '該当トピック: R' || n_regionkey || '（x & y, ）｜出典: ' || n_name || CASE WHEN n_nationkey % 2 = 1 THEN '・はてブ検索経由' ELSE '' END ||
CASE WHEN n_nationkey % 3 = 0 THEN '｜同じ話題: 他2媒体（p、q）' ELSE '' END || '｜スコア ' || printf('%.2f', n_nationkey / 10.0) AS summary,
CASE WHEN n_nationkey % 2 = 0 THEN 1700000000 + n_nationkey * 3600 ELSE CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) END AS published FROM nation""",
    "history_file": """SELECT CAST(p_partkey AS INTEGER) AS read_rank, 'a "quoted", ' || p_name || chr(10) || 'line' AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS source, 'https://p.example/' || p_partkey AS url, '' AS published,
CAST(p_partkey AS VARCHAR) AS received, CAST(p_partkey AS VARCHAR) AS feed_url, CAST(p_partkey AS VARCHAR) AS feedly_meme, CAST(p_partkey AS VARCHAR) AS summary, CAST(p_partkey AS VARCHAR) AS entry_id FROM part""",
    "state_versions": """SELECT 'u' || user_id || '.example' AS domain, event_type AS publisher, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, event_type AS examples FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type""",
    "decoded_links": "SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day, 'http://e.example/' || event_type || '/あ+%zz' AS link FROM events",
}
# The same results by other ways: as a stream, from partials, in a store and by a membership filter.
ORACLE_SQL |= {"stream_discovered": ORACLE_SQL["discovered_upsert"], "partial_shares": ORACLE_SQL["topic_share"], "partial_terms": ORACLE_SQL["top_terms"]}
ORACLE_SQL |= {"store_media": ORACLE_SQL["discovered_upsert"], "store_days": ORACLE_SQL["retention_seen"], "seen_by_filter": ORACLE_SQL["seen_urls"]}
