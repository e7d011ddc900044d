import re

from newsloom.llm import decontaminate as D


def plain(text, items, width=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    doc, hit, ids = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    ids.add(item)
    return len(doc), hit, ids


ITEMS = [("1", "The quick, brown FOX jumps over the lazy dog and then some more words"), ("2", "short one"), ("10", "short one"), ("3", "ÉTÉ à la plage"), ("4", "...")]
TEXTS = [
    None,
    "",
    "... !!",
    "A short-one here; shorts one",
    "x the quick brown fox jumps over the lazy dog and y and then some more words",
    "the quick brown fox jumps over the lazy dog and then some more words " * 3,
    "short one short one",
    "ÉTÉ à la plage. été à la plage",
    ("filler words " * 3000) + "short one" + " tail" * 3000,
]


def test_scan_matches_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("doc_id", "n_words")
    bench = spark.createDataFrame([(i, t) for i, t in ITEMS] + [(None, "short one"), ("9", None)], "item_id string, text string")
    for chars in (D.MAX_PATTERN_CHARS, 300):  # one automaton, and several blocks
        rows = D.with_hits(spark, docs, bench, max_pattern_chars=chars).select("n_words", "benchmark_hits").collect()
        for r in rows:
            n, hit, ids = plain(TEXTS[r.n_words], ITEMS)
            h = r.benchmark_hits
            assert h.n_words == n and set(h["items"]) == ids and h["items"] == sorted(h["items"])
            assert {p for s, e in zip(h.starts, h.ends, strict=True) for p in range(s, e)} == hit


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Hey: A SHORT -- One! bye"), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    (row,) = D.contaminated_spans(spark, docs, bench).collect()
    assert row.doc_id == 1 and [("Hey: A SHORT -- One! bye")[s.start : s.end] for s in row.spans] == ["SHORT -- One"] and row["items"] == ["10", "2"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert D.with_hits(spark, docs.limit(0), bench).count() == 0
    assert D.without_contaminated(spark, docs, bench.limit(0)).count() == 1


def test_query_matches_brute_force(spark, sf_dir):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        for w in D.windows_of(t, 10):
            windows.setdefault(w, set()).add(i)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = D.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = D.normal_words(texts[r.doc_id])
        hit, ids = set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if of := windows.get(tuple(words[j : j + k])):
                    hit.update(range(j, j + k))
                    ids |= of
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == D.items_digest(sorted(ids))
