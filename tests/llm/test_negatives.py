import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import negatives as n
from newsloom.llm.common import new_path


def plain(rows, is_anchor, positives=5, negatives=10):
    """Every row against every anchor."""
    vectors = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        vectors[i] = min(row, vectors.get(i, row))
    out = []
    for a, (label, q) in vectors.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, other, strict=False)), i, mine) for i, (mine, other) in vectors.items() if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(a, p, k, i, -score, -s) for k, (s, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, q string, id int")
    found = n.hard_negatives(spark, n.whole_vectors(df, "vec_id", F.col("label"), "embedding"), anchor, new_path(spark, "test-negatives"), **more)
    return sorted(map(tuple, found.collect()))


def made(rng, rows, size, spread):
    """Vectors around their labels' middles, some equal, some tiny, some of opposite sign."""
    middle = rng.normal(size=(4, size))
    for i in range(rows):
        label = int(rng.integers(4))
        v = middle[label] * spread + rng.normal(size=size)
        v = np.round(v * (0.01 if i % 13 == 0 else 1), 1)
        yield i, label, [float(x) for x in (v if i % 11 else -v if i % 2 else np.ones(size))]


@pytest.mark.parametrize(("size", "spread"), [(1, 1.0), (3, 0.5), (16, 0.0), (33, 2.0)])
def test_equals_all_pairs(spark, size, spread):
    rows = list(made(np.random.default_rng(size), 300, size, spread))
    odd = [(None, 1, [1.0] * size), (900, None, [1.0] * size), (901, 1, None), (902, 1, [float("nan")] * size), (903, 1, [float("inf")] * size), (904, 1, [None] * size), (905, 2, [1.0] * (size - 1)), (906, 2, [])]
    odd += [(10, 0, [9.0] * size), rows[7], rows[20], rows[20]]
    want = plain([*rows, *odd], lambda i: i % 10 == 0)
    assert want
    assert mined(spark, [*rows, *odd], F.col("id") % 10 == 0) == want
    assert mined(spark, [*rows, *odd], F.col("id") % 10 == 0, round_bytes=2000) == want  # many rounds


def test_few_rows_and_none(spark):
    assert mined(spark, [], F.col("id") % 10 == 0) == []
    assert mined(spark, [(0, 1, [1.0])], F.col("id") == 0) == []
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.95]), (4, 3, [0.29])]
    assert mined(spark, rows, F.col("id") == 0) == [(0, 1, 1, 2, 65536, 32768)]


def test_pairs_are_discarded_early_and_bounds_hold():
    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(2000, 64)) * np.r_[np.full(8, 300.0), np.full(56, 10.0)]).astype(np.int64)
    axes = np.linalg.eigh(base.T.astype(float) @ base)[1][:, ::-1]
    rows = n.turned(np.arange(2000), np.arange(2000) % 4, base, axes)
    exact = base[:40] @ base.T
    for stage, k in enumerate(n.stages_of(64)):
        part = rows.y[:40, :k] @ rows.y[:, :k].T
        rest = rows.rests[stage][:40, None] * rows.rests[stage][None] + n.slack_of(axes) * rows.norms[:40, None] * rows.norms[None]
        assert (abs(exact - part) <= rest + 1e-6).all()
    anchors = rows.at(slice(0, 40))
    search = n.Search(anchors, axes, np.full((40, 1), n.NONE + 1), np.full((40, 1), np.iinfo(np.int64).max), True, 5)
    for at in range(0, 2000, 250):
        search.add(rows.at(slice(at, at + 250)))
    assert search.survived < search.seen / 4
    got = defaultdict(list)
    for slot, score in zip(*search.found[:2], strict=True):
        got[slot].append(score)
    for a in range(40):
        assert got[a] == sorted((exact[a, i] for i in range(2000) if i % 4 == a % 4 and i != a), reverse=True)[:5]


def test_vectors_without_leading_components_are_discarded_in_blocks(monkeypatch):
    """Few pairs are looked at one by one, and the rows kept are sorted now and then, not after each block."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6000, 64))
    base = np.floor(256 * base / np.linalg.norm(base, axis=1)[:, None]).astype(np.int64)
    labels = np.arange(6000) % 7
    axes = np.linalg.eigh(base.T.astype(float) @ base)[1][:, ::-1]
    rows = n.turned(np.arange(6000), labels, base, axes)
    exact = base[:100] @ base.T
    best_of = np.array([np.sort(exact[a, (labels == a % 7) & (np.arange(6000) != a)])[:-6:-1] for a in range(100)])
    low, high = -((-30 * best_of) // 100), 90 * best_of // 100
    looked, ordered, verify, best = [], [], n.Search.verify, n.best
    monkeypatch.setattr(n.Search, "verify", lambda self, rows, ri, *more: (looked.append(len(ri)), verify(self, rows, ri, *more))[1])
    monkeypatch.setattr(n, "best", lambda slot, *more: (ordered.append(len(slot)), best(slot, *more))[1])
    search = n.Search(rows.at(slice(0, 100)), axes, low, high, False, 10)
    for at in range(0, 6000, 100):
        search.add(rows.at(slice(at, at + 100)))
    got = defaultdict(list)
    for slot, score, i in zip(*search.found, strict=True):
        got[slot].append((-score, i))
    for a in range(100):
        for band in range(5):
            fit = [(-exact[a, i], i) for i in range(6000) if i % 7 != a % 7 and low[a, band] <= exact[a, i] <= high[a, band]]
            assert got[5 * a + band] == sorted(fit)[:10]
    assert sum(looked) < search.seen / 8
    assert sum(ordered) < 30 * 100 * 5 * 10  # thirty times what the slots hold


def test_query_equals_its_sql(spark, sf_dir):
    got = n.query(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(n.SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
