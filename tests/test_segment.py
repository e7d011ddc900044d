"""Segmentation: the cheapest of all ways to cut, and the terms of the words."""

import random

from pyspark.sql import functions as F

from newsloom.functions import segment
from newsloom.functions.segment import RUNS, Entry, cut, parse_lexicon, segmented
from newsloom.functions.text import noun_terms

WORDS = """生成,1,1,300,名詞,サ変接続
AI,1,1,300,名詞,固有名詞
人工知能,1,1,400,名詞,一般
人工,1,1,300,名詞,一般
知能,1,1,300,名詞,一般
が,2,2,50,助詞,格助詞
医療,1,1,200,名詞,一般
を,2,2,50,助詞,格助詞
変える,3,3,200,動詞,自立
変,1,1,500,名詞,一般
東京,1,1,200,名詞,固有名詞
東,1,1,300,名詞,一般
京都,1,1,200,名詞,固有名詞
都,4,4,100,名詞,接尾
それ,5,5,100,名詞,代名詞"""
CONNECTIONS = "6 6\n1 2 -50\n2 3 -50\n1 4 -80\n1 1 20\n0 1 -10\n3 0 -20"
LEXICON = parse_lexicon(WORDS.splitlines(), CONNECTIONS.splitlines())


def total(path, lexicon):
    ids = [0, *(e.right for e in path)]
    return sum(e.cost for e in path) + sum(lexicon.join(r, e.left) for r, e in zip(ids, path, strict=False)) + lexicon.join(ids[-1], 0)


def every_way(text, lexicon):
    """All paths, by going on from each place with everything that may stand there."""
    ends = {i: m.end() for m in RUNS.finditer(text) for i in range(m.start(), m.end())}

    def ways(at):
        if at == len(text):
            yield []
            return
        options = [(at + 1, lexicon.unknown), (ends[at], lexicon.unknown)] + [(at + len(w), e) for w, es in lexicon.words.items() if text.startswith(w, at) for e in es]
        for end, entry in set(options):
            for rest in ways(end):
                yield [entry, *rest]

    return ways(0)


def test_cheapest_of_all_ways():
    r = random.Random(3)
    for _ in range(60):
        letters = "東京都人工知能aぁア。 "
        entries = ["".join(r.choices(letters[:6], k=r.randint(1, 3))) for _ in range(8)]
        lines = [f"{w},{r.randint(0, 3)},{r.randint(0, 3)},{r.randint(-50, 400)},名詞,一般" for w in entries]
        joins = [f"{a} {b} {r.randint(-200, 200)}" for a in range(4) for b in range(4)]
        lexicon = parse_lexicon(lines, joins, Entry(0, 0, r.randint(50, 500), "名詞", "一般"))
        text = "".join(r.choices(letters, k=r.randint(1, 8)))
        got = list(cut(text, lexicon))
        assert "".join(s for s, _ in got) == text
        assert total([e for _, e in got], lexicon) == min(total(p, lexicon) for p in every_way(text, lexicon))


def test_words_are_given_out_early_and_the_same(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choices([*LEXICON.words, "未知", "カタカナ", "。", " ", "x1"], k=4000))
    whole = list(cut(text, LEXICON))
    monkeypatch.setattr(segment, "SETTLE_EVERY", 7)
    assert list(cut(text, LEXICON)) == whole and "".join(s for s, _ in whole) == text
    early = 0
    for _ in cut("が" * 10**6, LEXICON):  # the first words come before the text was read to its end
        early += 1
        if early == 100:
            break
    assert early == 100


def test_terms_of_texts(spark):
    rows = [(1, "生成AIが医療を変える"), (2, "東京都"), (3, "人工知能"), (4, "それが医療"), (5, ""), (6, None), (7, "　 "), (8, "ＡＩ医療")]
    df = spark.createDataFrame(rows, "i int, text string")
    df = df.withColumn("words", segmented(spark, "text", LEXICON))
    cuts = {r.i: None if r.words is None else [w.surface for w in r.words] for r in df.collect()}
    assert cuts == {1: ["生成", "AI", "が", "医療", "を", "変える"], 2: ["東京", "都"], 3: ["人工知能"], 4: ["それ", "が", "医療"], 5: [], 6: None, 7: [], 8: ["AI", "医療"]}
    terms = {r.i: set(r.t or []) for r in df.select("i", noun_terms("words").alias("t")).collect()}
    assert terms[1] == {"生成", "AI", "生成AI", "医療"} and terms[2] == {"東京"} and terms[4] == {"医療"} and terms[8] == {"AI", "医療", "AI医療"}
    assert df.limit(0).select(F.size("words")).count() == 0
