import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import packing, tokens

PATH = public_tokenizers.path(tokens.VOCABULARY)
ODD = [
    None, "", " ", "a  b", " a", "a ", "a <|endoftext|> b", "<|endoftext|>", "x\n\ny  z \n q", "don't we'll 123 4a b4", "　a b　c", "日本語 のテキスト です",
    "é à ü", "emoji 😀 👍🏽 x", "a\x1cb c\x1c d", "\t\tx y", "a \tb", "tab\there and there", "x \u0085 y", "﻿a b", "word, (words) [w] #tag", "long " * 9000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def chunks():
    with open(PATH, "rb") as f:
        definition = f.read()
    return tokens.Encoder(definition), tokens.whole_tokens(definition)


def agree(texts, chunks, library):
    found, whole = chunks
    pieces, index, begin = found.cut(pa.array([t or "" for t in texts], pa.string()))
    counts = np.array([found.count(p, whole) for p in pieces])[index]
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert found.ids(text or "").tolist() == want
        assert "".join(pieces[j] for j in index[begin[i] : begin[i + 1]]) == (text or "")
        assert counts[begin[i] : begin[i + 1]].sum() == len(want)


def test_odd_texts_agree_with_the_library(chunks, library):
    agree(ODD, chunks, library)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'ab1é<|> \x1c"), st.characters(codec="utf-8"))), max_size=4))
def test_any_texts_agree_with_the_library(chunks, library, texts):
    agree(texts, chunks, library)


def test_counts_with_nulls_repeats_and_extra_columns(spark, library):
    rows = [(i, t, i, "x") for i, t in enumerate(ODD)] + [(None, "a b", 1, "y"), (3, "a  b", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, id string")
    got = tokens.token_counts(spark, docs, PATH).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(spark, docs.limit(0), PATH).count() == 0


def test_other_libraries(spark):
    docs = spark.createDataFrame([(1, "Hello world again"), (2, None)], "doc_id long, text string")
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.id: r.n_tokens for r in tokens.token_counts(spark, docs, model).collect()}
    assert got == {1: len(sentencepiece.SentencePieceProcessor(model_file=model).encode("Hello world again")), 2: 0}
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.id: r.n_tokens for r in tokens.token_counts(spark, docs, path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode("Hello world again", add_special_tokens=False).ids), 2: 0}


def test_token_query_matches_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = tokens.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


@given(st.integers(1, 20000))
def test_cuts_fill_their_classes(n):
    found = packing.cuts(n, 2048)
    assert sum(length for length, _ in found) == n
    assert all(1 <= length and k * length <= 2048 < (k + 1) * (length + 1) for length, k in found)


def check_packing(rows, texts, library, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.id if hasattr(r, "id") else r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    sums = [sum(r.length for r in held) for held in by_sequence.values()]
    return sum(0 if s & (s - 1) == 0 else capacity - s for s in sums) / sum(sums)


def test_packing_query_is_an_exact_round_trip(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(packing.query(spark, sf_dir).collect(), texts, library) < 0.02


def test_packing_of_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 7)  # many buckets
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, bucket string")
    rows = packing.harmonic_packing(spark, docs, PATH, with_ids=True).collect()
    check_packing(rows, dict(enumerate(ODD)), library)
    assert all(len(r.ids) == r.length for r in rows)
    repeated = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.harmonic_packing(spark, repeated, PATH).count() >= 3
    assert packing.harmonic_packing(spark, docs.limit(0), PATH).count() == 0
