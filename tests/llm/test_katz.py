import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import katz

END = ("end",)


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Plain:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            tokens = words_of(text)
            for k in range(order):
                self.counts[k].update(tuple(tokens[i : i + k + 1]) for i in range(len(tokens) - k))
        self.total = sum(self.counts[0].values())
        self.discounts = []
        for c in self.counts:
            of = Counter(c.values())
            self.discounts.append(katz.Discounts([of[r] for r in range(1, katz.CUTOFF + 2)], len(c), sum(c.values())))
        self.after = [defaultdict(list) for _ in range(order)]
        for k in range(order):
            for gram in self.counts[k]:
                self.after[k][gram[:-1]].append(gram[-1])

    def star(self, gram):
        k = len(gram) - 1
        c = self.counts[k][gram]
        return float(self.discounts[k].kept(np.array([c]))[0]) / (self.counts[k - 1][gram[:-1]] if k else self.total)

    def p(self, gram):
        """P(last | the others), by recursion."""
        k = len(gram) - 1
        if self.counts[k][gram]:
            return self.star(gram)
        if not k:
            return 1 - sum(self.star((w,)) for (w,) in self.counts[0]) if self.total else 1.0
        seen = self.after[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        weight = (1 - sum(self.star((*gram[:-1], w)) for w in seen)) / (1 - sum(self.p((*gram[1:-1], w)) for w in seen))
        return weight * self.p(gram[1:])

    def score(self, text):
        tokens = words_of(text)
        return sum(math.log10(self.p(tuple(tokens[max(0, i - self.order + 1) : i + 1]))) for i in range(len(tokens)))


TEXTS = [None, "", "a", "A b\tc", "a b c d e", "x y z a b", "new words only", "a  b ", " É é à", "q " * 3000, "a b c d e", *(" ".join("abcdefgh"[(i * j * 7 + j) % 8] for j in range(i)) for i in range(3, 40))]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_the_definition(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BATCH_BYTES", 200)  # many batches
    monkeypatch.setattr(katz, "SHARD_TOKENS", 300)  # and shards
    monkeypatch.setattr(katz, "LEAST_BITS", 3)
    held = {2, 5, 6, 9, 12, 20}
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, batch int")
    rows = katz.katz_scores(spark, docs, F.col("doc_id").isin(*held), order=order).collect()
    plain = Plain([t for i, t in enumerate(TEXTS) if i not in held], order)
    assert len(rows) == len(TEXTS)
    for r in rows:
        tokens = words_of(TEXTS[r.id])
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(tokens), plain.total, r.id in held)
        counts = [plain.counts[0][(w,)] for w in tokens]
        assert r.n_known == sum(c > 0 for c in counts)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (plain.total + len(plain.counts[0]) + 1)) for c in counts))
        assert r.score == pytest.approx(plain.score(TEXTS[r.id]), rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_add_up_to_one(order):
    plain = Plain([t for t in TEXTS if t], order)
    vocabulary = [w for (w,) in plain.counts[0]] + ["never seen"]
    contexts = [g for k in range(order) for g in [(), *plain.counts[k]] if len(g) == k and END not in g] + [("never", "seen")[: order - 1]]
    for context in contexts:
        assert sum(plain.p((*context, w)) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_empty_tables_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c")], "doc_id long, text string")
    got = sorted(map(tuple, katz.katz_scores(spark, docs, F.coalesce(F.col("doc_id") == 7, F.lit(True))).collect()), key=str)
    assert len(got) == 3 and got[0][:5] == (1, False, 3, 3, 6) and got[2][:5] == (None, True, 3, 2, 6)
    assert katz.katz_scores(spark, docs.limit(0), F.lit(False)).count() == 0
    nothing = katz.katz_scores(spark, docs, F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in nothing)


def test_query_beats_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in katz.query(spark, sf_dir).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
