from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from newsloom.llm import decontaminate, linefreq, simgroups, tokens
from tests.llm.test_linefreq import plain as plain_lines


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarities(rows):
    """(a, b, Jaccard similarity of the five-word shingles) of all pairs that share one; wordless texts are equal."""
    held = {d: shingles(t) for d, t in rows}
    for i, a in enumerate(held):
        for b in list(held)[i + 1 :]:
            both = len(held[a] & held[b])
            if both or not (held[a] or held[b]):
                yield a, b, both / (len(held[a] | held[b]) or 1) if both else 1.0


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_match_plain_forms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src1", None), (10_002, "12345 !!", "en", "src1", 8), (10_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    one = P.language(spark, docs, sf_dir)
    before, after = rows_of(docs), rows_of(one)
    assert set(after) == {r for r in before if any(map(str.isalpha, r[1] or ""))}  # clean documents stay as they are
    two = P.lines(spark, one, sf_dir)
    want = {d: t for d, _, t in plain_lines([(r[0], r[3], r[1]) for r in after], linefreq.RATIO, linefreq.LEAST_PAGES)}
    got = rows_of(two)
    assert {r[0]: r[1] for r in got} == want and all(r[4] == len(r[1]) for r in got)
    three = P.near_duplicates(spark, two, sf_dir)
    kept = {r[0] for r in rows_of(three)}
    assert set(rows_of(three)) <= set(got)
    pairs = list(similarities([(r[0], r[1]) for r in got]))
    assert any(s >= 0.8 for _, _, s in pairs)
    assert not [(a, b, s) for a, b, s in pairs if s >= 0.8 and {a, b} <= kept]
    near = {d for a, b, s in pairs if s >= 0.8 for d in (a, b)}
    assert {r[0] for r in got} - kept <= near
    four = P.benchmark(spark, three, sf_dir)
    windows = {w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in decontaminate.windows_of(r.text, 10)}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = decontaminate.normal_words(text)
        return not any(tuple(words[i : i + k]) in windows for k in sizes for i in range(len(words) - k + 1))

    left = rows_of(four)
    assert {r[0] for r in left} == {r[0] for r in rows_of(three) if clean(r[1])}
    for df in (one, two, three, four):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in P.pack(spark, four, sf_dir).collect():
        by_doc[r.doc_id] += [(r.start, list(r.ids))]
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for r in left:
        ids = [i for _, piece in sorted(by_doc.pop(r[0])) for i in piece]
        assert ids == [*library.encode(r[1], add_special_tokens=False).ids, 1]
    assert not by_doc
    for held in by_sequence.values():
        at = np.cumsum([0] + [n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == at[:-1].tolist() and at[-1] <= 2048


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, sf_dir).collect())) == sorted(map(key, docs.collect()))


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, "some words here", None, None, None), (5, "same words again and again", "en", "s", 1), (5, "same words again and again", "en", "s", 1), (6, None, "en", "s", 0), (7, "", "en", "s", 0), (8, "w " * 60_000, "fr", "s", 2)]
    extra = ["found_language", "benchmark_hits", "line", "boilerplate_lines", "boilerplate_site", "n_lines", "copy_id", "again_id", "repeated", "id", "text_hash", "root", "site", "goes"]
    odd = spark.createDataFrame(odd, docs.schema).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in extra})
    stage = dict(P.STAGES)[name]
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    out = stage(spark, odd, sf_dir).collect()
    assert out
    if name != "packing":
        assert out[0].__fields__ == odd.columns
        assert all(r[c] == f"{c}{'' if r.doc_id is None else r.doc_id}" for r in out for c in extra)
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in out) == ["5", "6", "8", "None"]  # 6 and 7 are equal: no words


def test_clashing_rows_of_one_id(spark):
    """Texts that share an id are documents of their own; copies go."""
    docs = spark.createDataFrame([(1, "b c d e"), (1, "a b c d"), (2, "a b c d"), (None, "b c d e")], "doc_id long, text string")
    assert sorted(map(str, rows_of(simgroups.one_of_each_group(spark, docs)))) == ["(1, 'a b c d')", "(1, 'b c d e')", "(None, 'b c d e')"]
