import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import outliers as o

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, one by one."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def vector(c):
    angle = lambda share: np.arcsin(np.sqrt(share))
    v = np.log(c[1] / c[0]), angle(c[2] / (c[2] + c[0])), angle(c[3] / (c[5] + 8)), angle(c[4] / c[0])
    return [int(np.floor(x * 1024 + 0.5)) for x in v]


def estimate(rows):
    """Mean and covariance of the half with the least determinant, step by step over all rows."""
    x = np.array(rows) / 1024
    floors = np.diag(np.array(o.FLOORS) ** 2)
    middle = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    centre = middle(x)
    s = np.sqrt((middle(abs(x - centre)) * 1.4826) ** 2 + np.array(o.FLOORS) ** 2)
    bent = np.round(np.tanh((x - centre) / s) * 1024) / 1024
    c = np.cov(bent.T, bias=True)
    d = np.sqrt(np.diag(c))
    r = np.where(np.outer(d, d) > 0, c / np.where(np.outer(d, d) > 0, np.outer(d, d), 1), 0)
    np.fill_diagonal(r, 1)
    far = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    found = []
    for c in (np.diag(s**2), np.outer(s, s) * r):
        m, before = centre, None
        for _ in range(o.MOST_STEPS):
            bins = np.floor(o.BINS * np.log2(np.maximum(far(m, c), 0) + 2.0**-20))
            half = bins <= np.sort(bins)[(len(x) + o.P + 1) // 2 - 1]
            if before is not None and (half == before).all():
                break
            m, c, before = x[half].mean(0), np.cov(x[half].T, bias=True) + floors, half
        found.append((np.linalg.slogdet(c)[1], len(found), m, c, half.mean()))
    _, _, m, c, share = min(found, key=lambda f: f[:2])
    q = o.quantile(min(share, 0.99))
    within = far(m, c * min(share, 0.99) / o.chi_square(q, 6)) <= o.quantile(0.975)
    q = o.quantile(0.975)
    return x[within].mean(0), (np.cov(x[within].T, bias=True) + floors) * 0.975 / o.chi_square(q, 6)


def texts(rng, n):
    """Documents with words of their language's length, a tenth full of symbols, a tenth of very long words, some repeating themselves."""
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(50, 90))]
        if i % 10 == 3:
            words = [w + "#$" for w in words]
        if i % 10 == 7:
            words = [w * 6 for w in words]
        if i % 9 == 0:
            words += words[: len(words) // 3]
        yield "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7)) + ("\nsame line\nsame line" if i % 4 == 0 else "")


ODD = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n \nx \n", "#*$%&|<> a", "é ü\x0bß\x0c\rç d", "w " * 60, "long " + "ab cd ef gh " * 9000]


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(5)
    rows = [(i, t, "fr" if i % 60 == 0 else "en" if i % 3 else "de", "s1" if i % 2 else f"s{i % 50}") for i, t in enumerate(texts(rng, 1500))]
    rows += [(10_000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, rows[0][1], "en", "s1"), (5, rows[5][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, r[0], "x") for r in rows], "doc_id long, text string, lang string, source string, n_words long, kept string")
    return rows, o.judged(spark, docs).collect()


def test_counts_and_base_rules_are_those_of_each_text(found):
    rows, got = found
    want = Counter((r[0], *counts(r[1]), failed(counts(r[1]))) for r in rows)
    assert want == Counter((g.id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.n_lines, g.base_failed) for g in got)


def test_verdicts_are_those_of_the_plain_form(found):
    rows, got = found
    fit = [(r, vector(c)) for r in rows if not failed(c := counts(r[1]))]
    per, lang = Counter((r[2], r[3]) for r, _ in fit), Counter(r[2] for r, _ in fit)
    key = lambda r: (r[2], r[3]) if per[r[2], r[3]] >= o.LEAST_ROWS else (r[2],) if lang[r[2]] >= o.LEAST_ROWS else ()
    feeds = {k: [v for r, v in fit if (r[2], r[3])[: len(k)] == k] for k in {key(r) for r, _ in fit}}
    assert {len(k) for k in feeds} == {0, 1, 2}  # with source, of a language, of all
    estimates = {k: estimate(v) for k, v in feeds.items()}
    want = {}
    for r, v in fit:
        m, c = estimates[key(r)]
        x = np.array(v) / 1024 - m
        want[r[0], r[1], r[3]] = x @ np.linalg.inv(c) @ x
    judged = {(r[0], r[3]): r for r in rows}
    for g in got:
        if g.base_failed:
            assert not g.kept and g.distance is None
            continue
        d = want[g.id, judged[g.id, g.source][1], g.source]
        assert g.distance == pytest.approx(d, rel=1e-6, abs=1e-9) and g.kept == (d <= o.quantile(o.REJECTED))


def test_full_of_symbols_goes_and_plain_stays(found):
    _, got = found
    own = [g for g in got if g.id is not None and g.id < 1500 and not g.base_failed]
    assert not any(g.kept for g in own if g.id % 10 in (3, 7))
    plain = [g.kept for g in own if g.id % 10 not in (3, 7) and g.id % 9]  # every ninth repeats a third of itself
    assert sum(plain) > 0.98 * len(plain)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t", max_size=60), min_size=1, max_size=8))
def test_repeats_when_hashes_meet(spark, made):
    """Even if all windows have one hash, or one of two, the words decide."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "id int, text string")
    words = docs.select("id", o.words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    for hash_of in (F.xxhash64, lambda *w: F.lit(0).cast("long"), lambda *w: F.pmod(F.xxhash64(*w), F.lit(2))):
        got = {r.id: r.n_repeat_words for r in o.with_repeats(words, hash_of).select("id", "n_repeat_words").collect()}
        assert got == {i: counts(t)[4] for i, t in enumerate(made)}


def test_many_estimates_meet_by_salted_keys_and_tables_may_be_empty(spark):
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("x"))
    small = spark.createDataFrame([(str(i) if i else None, i * 10) for i in range(7)], "key string, y int")
    rows = rows.withColumn("key", F.nullif("key", F.lit("0")))
    few, many = (sorted(map(tuple, o.met_with(spark, rows, small, ["key"], limit).collect()), key=str) for limit in (100, 1))
    assert few == many and len(few) == 1000
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert o.judged(spark, none).count() == 0


def test_query_is_native_and_whole(spark, sf_dir):
    got = o.query(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count()
    plan = o.counted(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        c = counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*c[:5], failed(c))
        assert not (r.kept and r.base_failed)
