import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import alignment as al
from newsloom.llm.tokens import VOCABULARY

A, B = public_tokenizers.path(VOCABULARY), public_tokenizers.path(al.PIECES)
ODD = [
    None, "", " ", "a", "a  b", " a ", "\n", "▁x", "x ▁", "<|endoftext|> a", "<s> </s> <0x0A>", "don't", "日本語 のテキスト です。日本語", "é à ü ß", "emoji 😀 👍🏽 x", "a\x1cb\x00c", "\t\tx\ry", "ﬁ ½", "aaaa " * 50, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢",
    "一" * 30, "x" * 500, "word, (words) [w] #tag 12345",
]


class Plain:
    """Alignment token by token with the libraries, and counts over all documents."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(self, text):
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    def groups(self, text):
        if not text:
            return []
        a, b = self.tokens(text)
        if {b"".join(t for _, t in x) for x in (a, b)} != {(" " + text).encode()}:
            return []
        out, ia, ib, at_a, at_b = [[[], []]], 0, 0, 0, 0
        while ia < len(a) or ib < len(b):
            if at_a <= at_b and ia < len(a):
                out[-1][0].append(a[ia][0])
                at_a += len(a[ia][1])
                ia += 1
            else:
                out[-1][1].append(b[ib][0])
                at_b += len(b[ib][1])
                ib += 1
            if at_a == at_b and (ia < len(a) or ib < len(b)):
                out.append([[], []])
        return out

    def rows(self, texts):
        groups = [self.groups(t) for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
        counts = Counter(pair for k in links for pair in k)
        top = defaultdict(int)
        for (x, _), n in counts.items():
            top[x] = max(top[x], n)
        for g, k in zip(groups, links, strict=True):
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (
                sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(k.values()), sum(n for p, n in k.items() if counts[p] == top[p[0]]),
                sum(n * counts[p] for p, n in k.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
            )


@pytest.fixture(scope="module")
def plain():
    return Plain()


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [10**6, 40, 0])
def test_odd_texts_equal_the_plain_form(spark, plain, most):
    texts = [*ODD, "a common text of common words", "a common text of other words", "a common text of common words", "  a common\n\ntext"]
    rows = [(i if i % 7 else None, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, pairs string")
    got = al.alignment(spark, docs, A, B, most_frequent=most).select("id", *FIGURES).collect()
    want = [(r[0], *w) for r, w in zip(rows, plain.rows(texts), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if most == 40:  # then some pairs are sent and others shuffled
        n = [r.n for r in al.pair_counts(al.aligned(spark, docs, A, B)).collect()]
        assert 0 < sum(x >= al.frequent(spark.createDataFrame([(x,) for x in n], "n long"), 40) for x in n) <= 40 < len(n)


def test_no_rows(spark):
    assert al.alignment(spark, spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'ab1é<|> ▁日"), st.characters(codec="utf-8")), max_size=80))
def test_parts_are_encoded_as_the_whole(tokenizers, plain, text):
    found = list(al.parts_of(text, 5))
    assert " ".join(found) == text
    a, b = [], []
    for part in found:
        mine = plain.tokens(part)
        a += [i for i, _ in mine[0]]
        b += [i for i, _ in mine[1]]
    whole = plain.tokens(text)
    assert (a, b) == ([i for i, _ in whole[0]], [i for i, _ in whole[1]])
    got = tokenizers.encoded(text) if text else None
    want = plain.groups(text)
    assert (got is None) == (not want)
    if got:
        g = al.groups_of(tokenizers.lengths_a[got[0]], tokenizers.lengths_b[got[1]])
        assert [([*got[0][p:q]], [*got[1][r:s]]) for p, q, r, s, _ in zip(*g, strict=True)] == [(x, y) for x, y in want]


@pytest.fixture(scope="module")
def tokenizers():
    with open(A, "rb") as f, open(B, "rb") as g:
        return al.Tokenizers(f.read(), g.read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.lists(st.integers(0, 5), min_size=1, max_size=6)), max_size=12), st.integers(1, 40))
def test_links_in_runs_of_any_size(groups, most):
    """Small groups together, large ones by their distinct ids."""
    ends_a, ends_b = np.cumsum([len(a) for a, _ in groups], dtype=np.int64), np.cumsum([len(b) for _, b in groups], dtype=np.int64)
    g = al.Groups(ends_a - [len(a) for a, _ in groups], ends_a, ends_b - [len(b) for _, b in groups], ends_b, ends_a)
    a, b = (np.array([i for x in groups for i in x[k]], np.int64) for k in (0, 1))
    pairs, n = al.links(a, b, g, most)
    want = Counter((x << 32) + y for p, q in groups for x in p for y in q)
    assert dict(zip(pairs.tolist(), n.tolist(), strict=True)) == want and (np.diff(pairs) > 0).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=60))
def test_ranks_of_a_bitset(lengths):
    ends = np.cumsum(lengths)
    bits = al.Bits(ends, int(ends[-1])).ranked()
    assert al.selected(bits.words).tolist() == ends.tolist()
    places = np.arange(1, ends[-1] + 1)
    assert bits.rank(places).tolist() == [int((ends <= p).sum()) for p in places]


def test_very_long_text_and_query(spark, plain, sf_dir):
    long = " ".join(f"word{i % 977} läng{i % 13}" for i in range(60_000)) + " x" + "y" * 3000
    docs = spark.createDataFrame([(1, long), (2, "word1 läng1")], "doc_id long, text string")
    got = al.alignment(spark, docs, A, B).select("id", *FIGURES).collect()
    assert sorted(map(tuple, got)) == [(i, *w) for i, w in zip((1, 2), plain.rows([long, "word1 läng1"]), strict=True)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = al.query(spark, sf_dir).select("doc_id", *FIGURES).collect()
    assert sorted(map(tuple, got)) == sorted((d.doc_id, *w) for d, w in zip(docs, plain.rows([d.text for d in docs]), strict=True))
