import zlib

import numpy as np
import pytest

from newsloom.llm import quality


def test_fit_is_at_the_minimum_of_the_pair_loss():
    rng = np.random.default_rng(2)
    found, labels = rng.normal(size=(300, 4)), rng.integers(0, 2, 300)
    found[:, 0] += labels
    model = quality.fit(found, labels, penalty=1e-2)
    x = quality.expanded(found, model.centre, model.spread)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    order, n = np.random.default_rng(0), quality.PAIRS_EACH * max(len(good), len(bad))
    pairs = x[order.permutation(np.resize(good, n))] - x[order.permutation(np.resize(bad, n))]

    def loss(w):
        return np.log1p(np.exp(-pairs @ w)).mean() + 0.5e-2 * w @ w

    least = loss(model.weights)
    for i in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            assert loss(model.weights + step * np.eye(len(model.weights))[i]) > least
    above = (model.scores(found) >= quality.LIMIT).mean()
    assert above == pytest.approx(labels.mean(), abs=0.01)


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a", "a a a a", "é" * 500, "x" * 200_000, "word, " * 60_000])
def test_features_of_odd_texts(text):
    found = quality.features(text)
    assert np.isfinite(found).all() and found.shape == quality.features("").shape
    assert found[13] == pytest.approx(np.log1p(len((text or "").encode())))


def test_odd_rows(spark):
    good, bad = "A plain sentence of words, made well. Another one follows it here.", "spam spam spam spam ### $$$ spam spam"
    docs = spark.createDataFrame([(i, good + f" Number {i}." if i % 2 else bad * (1 + i % 3), "x", 0.5) for i in range(60)] + [(60, None, "x", 1.0), (None, "some text", "y", 0.0), (3, good, "z", 0.1)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(spark, docs, labels).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    mean = lambda k: np.mean([r.score for r in rows if r.id is not None and r.id < 60 and r.id % 2 == k])
    assert mean(1) > quality.LIMIT > mean(0)
    assert all(r.score == 0.5 for r in quality.quality_scores(spark, docs, labels.limit(0)).collect())
    assert quality.quality_scores(spark, docs.limit(0), labels).count() == 0


def test_held_out_ranking(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def plain_features(text):
    """The features, one after the other, from their definitions."""
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    n, w = max(1, len(data)), max(1, len(words))
    share = lambda x: x / w
    pairs = list(zip(words, words[1:], strict=False))
    out = [sum(data.count(bytes([b])) for b in c) / n for c in quality.CLASSES]
    out += [np.log(1 + len(data)), len(data) / w, share(len(set(words))), np.log(1 + len(set(words))) / np.log(1 + w), share(max((words.count(x) for x in set(words)), default=0))]
    out += [share(sum(a == b for a, b in pairs)), share(len(set(pairs))), share(sum(len(x) <= 3 for x in words)), share(sum(len(x) >= 15 for x in words))]
    return out + [len(set(lines)) / len(lines), np.log(1 + len(lines)), np.log(1 + w / len(lines)), len(zlib.compress(data, 1)) / n]


def test_query_matches_brute_force(spark, sf_dir, monkeypatch):
    """Features, fold, fit by plain gradient descent on the same pairs, quantile and squeeze, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    found = {r.doc_id: np.array(plain_features(r.text)) for r in docs}
    learned = [(i, y) for i, y in labels if not held(i) and i in found]
    x0 = np.array([found[i] for i, _ in learned])
    centre, spread = x0.mean(axis=0), np.maximum(x0.std(axis=0), 1e-9)
    wide = lambda v: np.hstack((x := np.clip((v - centre) / spread, -6, 6), x * x))
    good, bad = (wide(x0[[j for j, (_, y) in enumerate(learned) if y == k]]) for k in (1, 0))
    got = {r.doc_id: r for r in quality.query(spark, sf_dir).collect()}
    assert set(got) == set(found) and all(got[i].held_out == held(i) for i in found)
    # every pair of a good and a bad text, by gradient descent: another optimiser on all pairs ranks alike
    weights = np.zeros(good.shape[1])
    pairs = (good[:, None] - bad[None, :]).reshape(-1, good.shape[1])
    for _ in range(3000):
        won = 1 / (1 + np.exp(-np.clip(pairs @ weights, -40, 40)))
        weights -= 0.05 * (pairs.T @ (won - 1) / len(pairs) + quality.PENALTY * weights)
    ids = sorted(found)
    ours, plain = np.array([got[i].score for i in ids]), wide(np.array([found[i] for i in ids])) @ weights
    ranks = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(ranks(ours), ranks(plain))[0, 1] > 0.95
    above = plain >= np.quantile(wide(x0) @ weights, 1 - len(good) / len(learned))
    assert np.mean([above[j] == (got[i].predicted == 1) for j, i in enumerate(ids)]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
