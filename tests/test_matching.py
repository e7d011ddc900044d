import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions.text import NOUN, SETTLED, STOP_WORDS, noun_terms, story_tokens, telling
from newsloom.operators import matching
from newsloom.sources.config import Topic


def is_word(character):
    return character.isascii() and character.isalnum()


def plain_hit(term, text):
    """Whether a term occurs, character by character."""
    term = unicodedata.normalize("NFKC", term).strip()
    if not (term.isascii() and matching.is_cased(term)):
        term, text = term.lower(), text.lower()
    if not term.isascii():
        return term in text
    endings = ("", "s", "es") if len(term) > 3 and term[-1].isalpha() else ("",)

    def fits(at, rest):
        if not rest:
            return any(text.startswith(e, at) and not is_word(text[at + len(e) : at + len(e) + 1]) for e in endings)
        if rest[0] in " -":
            next_part, between = rest.lstrip(" -"), text[at : at + 1]
            return fits(at, next_part) or ((between.isspace() or between == "-") and fits(at + 1, next_part))
        return text.startswith(rest[0], at) and fits(at + 1, rest[1:])

    return any(fits(at, term) and not is_word(text[at - 1 : at]) for at in range(len(text)))


def plain_match(topic, text):
    text = unicodedata.normalize("NFKC", text or "")
    if any(plain_hit(k, text) for k in topic.exclude):
        return []
    return [k for k in topic.terms if plain_hit(k, text)]


def matched(spark, topics, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {(r.id, r.topic): r.keywords for r in matching.match_topics(spark, rows, topics, "id", "text").collect()}


CASES = [
    ("AI", "生成AIが話題", True),
    ("AI", "he said", False),
    ("SK", "SK hynixが増産", True),
    ("SK", "Skills API released", False),
    ("Meta", "a meta-analysis", False),
    ("AI", "ai", False),
    ("NVIDIA", "Nvidia posts", True),
    ("crypto", "Crypto falls", True),
    ("semiconductor", "Semiconductors rise", True),
    ("self-driving", "a self driving car", True),
    ("Claude Code", "新しいClaude Codeの話", True),
    ("スペースX", "スペースＸが打上げ", True),
    ("AI", "ＡＩの進歩", True),
    ("C++", "C++ news", True),
    ("box", "two boxes", False),
    ("match", "two matches", True),
]


def test_rules(spark):
    topics = [Topic(f"t{i}", [term]) for i, (term, _, _) in enumerate(CASES)]
    found = matched(spark, topics, [text for _, text, _ in CASES])
    for i, (term, text, hit) in enumerate(CASES):
        assert ((i, f"t{i}") in found) == hit, (term, text)


def test_excluded_terms_and_duplicates(spark):
    brain = Topic("brain", ["脳"], exclude=["首脳"])
    twice = Topic("twice", ["Netflix", "film"], ["Netflix"])
    found = matched(spark, [brain, twice], ["脳細胞の移植", "米中首脳会談", "a netflix film", None, ""])
    assert found == {(0, "brain"): ["脳"], (2, "twice"): ["Netflix", "film", "Netflix"]}


SIZES = pytest.mark.parametrize("few,broadcast", [(2_000, 100_000), (0, 100_000), (0, 0)])


@SIZES
def test_equals_plain_regular_expressions(spark, monkeypatch, few, broadcast):
    """Whatever the size of the index."""
    monkeypatch.setattr(matching, "FEW_ANCHORS", few)
    monkeypatch.setattr(matching, "BROADCAST_POSTINGS", broadcast)
    pick = random.Random(3)
    words = ["Meta", "meta", "AI", "ai", "models", "model", "self", "driving", "self-driving", "xAI", "Opus", "opuses", "宇宙", "ロケット", "首脳", "ＡＩ", "GPT-4", "gpt 4", "a", "the", "C++", "Ü", "宇宙ロケット", "++", ".NET", "net", "Selfdrivings", "é"]
    terms = ["Meta", "AI", "model", "self-driving", "Opus", "宇宙", "脳", "GPT-4", "C++", "driving", "ü", "a", "宇宙ロケット", "ロケット", "++", ".NET", "the a", "é a", "A+", "+A"]
    topics = [Topic(f"t{i}", pick.sample(terms, 4), pick.sample(terms, 2), pick.sample(terms, 1)) for i in range(9)]
    texts = [pick.choice(["", " ", ", ", "-"]).join(pick.choices(words, k=pick.randint(1, 8))) for _ in range(200)]
    found = matched(spark, topics, texts)
    for i, text in enumerate(texts):
        for t in topics:
            assert found.get((i, t.name), []) == plain_match(t, text), (text, t)


@SIZES
def test_rows_without_keys_and_repeated_texts(spark, monkeypatch, few, broadcast):
    monkeypatch.setattr(matching, "FEW_ANCHORS", few)
    monkeypatch.setattr(matching, "BROADCAST_POSTINGS", broadcast)
    rows = spark.createDataFrame([(None, "a red fox"), (1, "red-fox"), (2, "red fox"), (2, "red fox"), (3, None)], "id long, text string")
    got = matching.match_topics(spark, rows, [Topic("t", ["red fox", "fox"])], "id", "text").collect()
    assert sorted((r.id or 0, r.keywords) for r in got) == [(0, ["red fox", "fox"]), (1, ["red fox", "fox"]), (2, ["red fox", "fox"])]


def test_a_million_terms(spark):
    """One plan whatever the file; words and phrases that many terms share are no anchors."""
    word = lambda i: "".join("bcdfghjklm"[int(d)] + "a" for d in str(i))
    topics = [Topic("words", [word(i) for i in range(100_000)]), Topic("phrases", [f"news {word(i)}" for i in range(100_000)]), Topic("beyond", [f"都市{word(i)}" for i in range(800_000)], exclude=["zzz"])]
    terms = matching.term_table(spark, topics)
    assert terms.few is None and terms.n >= 1_000_000
    assert terms.postings.where("topic = 'phrases'").groupBy("anchor").count().agg(F.max("count")).first()[0] <= 8
    texts = [f"some {word(77)} and news-{word(23456)}", f"新都市{word(799_999)}", f"news{word(5)}", f"都市{word(3)} zzz", "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = matching.hits(rows.select("id", "text"), terms)
    got = {(r.id, r.topic): [h.keyword for h in r.hits] for r in found.collect()}
    want = {(i, t.name): [k for k in t.terms if plain_hit(k, texts[i])] for i, t in ((0, Topic("words", [word(77), word(23456)])), (3, Topic("words", [word(3)])), (0, Topic("phrases", [f"news {word(23456)}"])), (2, Topic("phrases", [f"news {word(5)}"])))}
    beyond = {k for n in (7, 79, 799, 7999, 79_999, 799_999) if (k := f"都市{word(n)}") in texts[1]}
    assert {k: v for k, v in got.items() if k[1] != "beyond"} == want
    assert set(got.pop((1, "beyond"))) == beyond and (3, "beyond") not in got
    small = matching.term_table(spark, [Topic("t", ["a b", "é", "ab", "日本語"])])
    monster = len(found._jdf.queryExecution().analyzed().toString())
    small.few, small.n = None, terms.n
    assert monster <= 1.2 * len(matching.hits(rows.select("id", "text"), small)._jdf.queryExecution().analyzed().toString())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abs1-. ’'Ａ京都カナ\n", max_size=25), min_size=1, max_size=20))
def test_story_tokens(spark, titles):
    """Words without hyphens and stops at their ends, without a plural's s; runs of Katakana and pairs of Han characters."""
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    for r in rows.select("t", story_tokens("t").alias("tokens")).collect():
        text = unicodedata.normalize("NFKC", r.t).lower()
        words = {w.strip("-.") for w in re.findall(r"[a-z0-9.\-]+", text)}
        words = {w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words}
        runs = re.findall("[\u4e00-\u9fff]+", text)
        want = {w for w in words if len(w) > 1 and w not in STOP_WORDS} | {run[i : i + 2] for run in runs for i in range(len(run) - 1)} | set(re.findall("[\u30a0-\u30ff]{2,}", text))
        assert len(r.tokens) == len(set(r.tokens)) and set(r.tokens) == want, r.t


def test_settled_characters_are_their_own_normal_form():
    settled = [c for c in map(chr, range(0x10000)) if re.match(f"[{SETTLED}]", c)]
    second = {chr(int(d[1], 16)) for c in map(chr, range(0x110000)) if len(d := unicodedata.decomposition(c).split()) == 2 and d[0][0] != "<"}
    assert len(settled) > 20_000 and not set(settled) & second
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in settled)


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "AI", "x", "y")], "id long, text string, keyword string, topic string")
    topics = [Topic("ai", ["AI"])]
    assert [r.keywords for r in matching.match_topics(spark, rows, topics, "id", "text").collect()] == [["AI"]]
    assert matching.match_topics(spark, rows.limit(0), topics, "id", "text").count() == 0


@pytest.mark.parametrize("n,kept", [(1, False), (2, True)])
def test_vetoes_need_two_different_keywords_in_a_summary(spark, n, kept):
    topic = Topic("money", ["Bitcoin"], ["crypto", "Bitcoin"])
    rows = spark.createDataFrame([(0, "none", " ".join(["Bitcoin", "crypto"][:n]))], "ord long, title string, summary string")
    assert bool(matching.vetoes(spark, rows, [topic]).where(F.col("veto") == "money").count()) == kept


def test_terms_of_a_tokenizers_words(spark):
    n = lambda s, kind="一般": (s, NOUN, kind)
    rows = [
        (0, [n("港"), n("町"), ("の", "助詞", "連体化"), n("観光"), n("情報")]),
        (1, [n("smart"), n("harbor"), n("2026", "数"), n("x"), n("これ", "代名詞"), n("灯台")]),
        (2, [n("長い"), n("港"), n("町"), n("通り"), ("、", "記号", "読点"), n("!?"), n("_1_")]),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "i int, words array<struct<surface: string, pos: string, kind: string>>")
    got = {r.i: r.t for r in df.select("i", noun_terms("words").alias("t")).collect()}
    assert {i: set(t) if t is not None else None for i, t in got.items()} == {0: {"港町", "観光", "観光情報"}, 1: {"smart", "harbor", "smart harbor", "灯台"}, 2: {"長い", "通り"}, 3: set(), 4: None}
    words = spark.createDataFrame([(["2026", "a1", "_-_", "あ", "12.5"],)], "w array<string>")
    assert words.select(telling(F.col("w"))).first()[0] == ["a1", "あ"]
