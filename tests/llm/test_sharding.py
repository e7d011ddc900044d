import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import sharding


def test_differencing_of_two_is_the_classic_one():
    found = sharding.difference([[w, 0] for w in (8, 7, 6, 5, 4)], 2)
    sums = [0, 0]
    for w, (to, _) in zip((8, 7, 6, 5, 4), found, strict=True):
        sums[to] += w
    assert sorted(sums) == [14, 16]  # the known outcome of differencing for this set


@pytest.mark.parametrize("shards,n", [(3, 9), (4, 8)])
def test_differencing_is_near_the_best(shards, n):
    rng = np.random.default_rng(n)
    weights = rng.integers(1, 100, n).tolist()
    found = sharding.difference([[w] + [0] * (shards - 1) for w in weights], shards)
    sums = [0] * shards
    for w, to in zip(weights, found, strict=True):
        sums[to[0]] += w
    best = min(max(sum(w for w, s in zip(weights, to, strict=True) if s == k) for k in range(shards)) for to in itertools.product(range(shards), repeat=n))
    assert max(sums) <= 1.15 * best


def test_partial_partitions_keep_their_parts_apart():
    rng = np.random.default_rng(1)
    partials = rng.integers(0, 50, (40, 5)).tolist()
    found = sharding.difference(partials, 5)
    sums = [0] * 5
    for vector, to in zip(partials, found, strict=True):
        used = [t for v, t in zip(vector, to, strict=True) if v]
        assert len(set(used)) == len(used)
        for v, t in zip(vector, to, strict=True):
            sums[t] += v
    assert max(sums) - min(sums) <= 5


def check(rows, texts, shards):
    of_text, slots, bytes_of = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        text = texts[r.id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        of_text[text].add(r.shard)
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(bytes_of) <= set(range(shards))
    return bytes_of


def test_odd_rows_and_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    texts = {i: t for i, t in enumerate([None, "", "a", "a", "é" * 1000, "b" * 30000, *(f"text {i}" * (i % 17) for i in range(300))])}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, shard int, key string")
    rows = sharding.shards_by_bytes(spark, docs, shards=4).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 4)
    groups = spark.createDataFrame([(f"k{i}", 1 + i * i % 97) for i in range(500)], "key string, weight long")
    placed = sharding.balanced_groups(spark, groups, 6, bucket_groups=20, fan=4).join(groups, "key").groupBy("shard").sum("weight").collect()
    sums = [r[1] for r in placed]
    assert len(sums) == 6 and max(sums) - min(sums) <= 12  # buckets of 20 leave little to balance with
    assert sharding.shards_by_bytes(spark, docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "q")] * 5, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shards_by_bytes(spark, same).collect()) == [0, 1, 2, 3, 4]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.query(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    assert len(rows) == len(texts) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    sums = check(rows, texts, 24).values()
    assert len(sums) == 24 and max(sums) - min(sums) <= 64
