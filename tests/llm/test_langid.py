import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import langid


def plain_scores(texts, labelled):
    """Multinomial naive Bayes over the same hashed n-grams, one position after the other."""
    def numbers(text):
        points, out = [ord(c) for c in f" {text.lower()} "], []
        for k in langid.ORDERS:
            for i in range(len(points) - k + 1):
                h = 0
                for c in points[i : i + k]:
                    h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                out.append((h * 0x85EBCA77 & 0xFFFFFFFF) >> 16)
        return out

    labels = sorted({x for x, _ in labelled})
    counts = {x: np.full(langid.BUCKETS, langid.SMOOTHING) for x in labels}
    for x, text in labelled:
        np.add.at(counts[x], numbers(text), 1)
    prior = {x: np.log(sum(y == x for y, _ in labelled) / len(labelled)) for x in labels}
    for text in texts:
        if not any(map(str.isalpha, text or "")):
            yield "und", 0.0
            continue
        sums = np.array([prior[x] + np.log(counts[x] / counts[x].sum())[numbers(text)].sum() for x in labels])
        odds = np.exp(sums - sums.max())
        yield labels[int(sums.argmax())], 1 / odds.sum()


LABELLED = [("en", "the cat and the dog"), ("en", "over the hill"), ("fr", "le chat et le chien"), ("fr", "sur la colline"), ("de", "der Hund und die Katze"), ("en", "")]
TEXTS = [None, "", "123 !", "the dog", "LE CHIEN", "die Katze", "x", "İé", "the " * 400_000, "le", "le"]


def test_scores_match_plain_form(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", 10)
    rows = [(i, t, x, "und") for i, (x, t) in enumerate(LABELLED)]
    labelled = spark.createDataFrame(rows + [(9, "no label", None, "x"), (10, None, "en", "x")], "bucket long, text string, lang string, score string")
    for size in (64, 1):  # one block, and several
        blocks = langid.learn(spark, labelled, block_languages=size)
        assert (len(blocks) == 1) == (size == 64) and sorted(x for b in blocks for x in b[0]) == ["de", "en", "fr"]
        docs = spark.createDataFrame([(*r, 1, 2) for r in enumerate(TEXTS)], "lang long, text string, best int, whole int")
        found = langid.with_language(spark, docs, blocks, "found")
        assert found.columns == [*docs.columns, "found"]
        check(found)


def test_a_text_in_pieces_has_the_odds_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    logs = np.vstack([rng.normal(size=(langid.BUCKETS, 5)), np.zeros(5)]).astype(np.float32)
    texts = ["", "a", "ab", "the cat sat on the mat İΣ", "x" * 37, "le chien " * 9]
    whole, counts = langid.text_odds(texts, np.arange(5.0), logs), [sum(np.bincount(n, minlength=langid.BUCKETS + 1) for n in langid.grams(*lot[1:])[0]) for lot in langid.pieces_of(texts)]
    for size in (1, 2, 3, 10, 50):
        monkeypatch.setattr(langid, "SLICE_CHARS", size)
        monkeypatch.setattr(langid, "GATHERED", 5 * (size + 1))
        assert np.allclose(langid.text_odds(texts, np.arange(5.0), logs), whole, atol=1e-9)
        again = sum(np.bincount(n, minlength=langid.BUCKETS + 1) for lot in langid.pieces_of(texts) for n in langid.grams(*lot[1:])[0])
        assert (again[:-1] == sum(counts)[:-1]).all()


def test_memory_does_not_grow_with_text_times_languages():
    logs = np.zeros((langid.BUCKETS + 1, 64), np.float32)
    text = "the quick brown fox " * 200_000
    tracemalloc.start()
    langid.text_odds([text], np.zeros(64), logs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000  # 4 million characters; their products with 64 languages alone are 1 GB


def test_query_equals_the_plain_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", langid.is_held_out("doc_id", 4).alias("held")).limit(1000).collect()
    rows = [r for r in rows if len(r.text or "") < 4000]  # one position after the other is slow
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean")
    found = {r.doc_id: r.f for r in langid.with_language(spark, few, langid.learn_from(spark, few), "f").collect()}
    labelled = [(r.lang, r.text) for r in rows if not r.held and r.lang is not None and r.text is not None]
    for r, (lang, score) in zip(rows, plain_scores([r.text for r in rows], labelled), strict=True):
        assert found[r.doc_id].lang == lang and found[r.doc_id].score == pytest.approx(score, abs=1e-4)
    got = {r.doc_id: r for r in langid.query(spark, sf_dir).collect()}
    assert len(got) == docs.count() and all(got[r.doc_id].held_out == r.held for r in rows)


def test_equal_odds_go_to_the_first_language(spark):
    labelled = spark.createDataFrame([("same text", "b"), ("same text", "a"), ("same text", "c")], "text string, lang string")
    docs = spark.createDataFrame([("same text",)], "text string")
    for size in (64, 1):
        r = langid.with_language(spark, docs, langid.learn(spark, labelled, block_languages=size), "f").first().f
        assert r.lang == "a" and r.score == pytest.approx(1 / 3)


def check(found):
    got = {r.lang: r.found for r in found.collect()}
    for i, (lang, score) in enumerate(plain_scores(TEXTS, LABELLED)):
        assert got[i].lang == lang and got[i].score == pytest.approx(score, abs=1e-4)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    blocks = langid.learn_from(spark, docs)
    assert langid.with_language(spark, docs, blocks, "f").first().f.asDict() == {"lang": "und", "score": 0.0}
    assert langid.with_language(spark, docs.limit(0), blocks, "f").count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = langid.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
