from collections import defaultdict

import public_tokenizers
import pytest

from newsloom.llm import packing
from newsloom.llm.tokens import VOCABULARY


@pytest.mark.parametrize("capacity", [512, 2048])
def test_offsets_follow_each_other_at_other_capacities(spark, capacity):
    docs = spark.createDataFrame([(i, "word " * (i % 600)) for i in range(1200)], "doc_id long, text string")
    rows = packing.harmonic_packing(spark, docs, public_tokenizers.path(VOCABULARY), capacity=capacity).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    mixed = 0
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        mixed += len({length for _, length in pieces}) > 1
    assert mixed


@pytest.mark.parametrize("capacity", [4096, 8192])
def test_sequences_of_buckets_stay_apart_at_any_capacity(spark, monkeypatch, capacity):
    """The class of a one-token rest is the capacity itself."""
    monkeypatch.setattr(packing, "BUCKET_PIECES", 60)
    docs = spark.createDataFrame([(i, "a" * (i % 2)) for i in range(600)] + [(1000 + i, "word " * (i * 37 % 900)) for i in range(200)], "doc_id long, text string")
    held = defaultdict(list)
    for r in packing.harmonic_packing(spark, docs, public_tokenizers.path(VOCABULARY), capacity=capacity).collect():
        held[r.sequence_id].append((r.offset, r.length))
    assert len(held) > 10
    for pieces in held.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity


def test_a_row_that_repeats_fills_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 50)
    docs = spark.createDataFrame([(None, "the same words")] * 400, "doc_id long, text string")
    rows = packing.harmonic_packing(spark, docs, public_tokenizers.path(VOCABULARY)).collect()
    assert len(rows) == 400 and len({(r.sequence_id, r.offset) for r in rows}) == 400
    assert len({r.sequence_id >> (packing.BIN_BITS + 12) for r in rows}) == 8
