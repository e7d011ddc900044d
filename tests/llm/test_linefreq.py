from collections import Counter

from pyspark.sql import functions as F

from newsloom.llm import linefreq


def plain(rows, ratio, least):
    """(id, host, text) -> texts without their site's boilerplate."""
    pages, held = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        held.update((h, x) for x in set((t or "").split("\n")) if x.strip(" \t\r"))
    bad = {k for k, n in held.items() if n >= least and n / pages[k[0]] > ratio}
    return [(i, h, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for i, h, t in rows]


def rows_of():
    rows = [(i, "big", f"menu\nline {i}\n\nmenu\n" + ("rare\n" if i < 3 else "") + "end") for i in range(40)]
    rows += [(100 + i, None, "menu\nno host") for i in range(6)] + [(200, "one", "menu\nonly page"), (201, "", "menu"), (202, "big", None), (203, "big", ""), (204, "big", "word " * 50000)]
    return rows + [(5, "big", "menu\nline 5"), (5, "big", "menu\nline 5")]


def test_matches_brute_force(spark, monkeypatch):
    rows = rows_of()
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, line int, site string")
    for bound in (linefreq.BROADCAST_LINES, 0):
        monkeypatch.setattr(linefreq, "BROADCAST_LINES", bound)
        got = linefreq.without_boilerplate(spark, pages, F.col("source"), least_pages=3, report=True)
        assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in got.collect()))) == sorted(map(str, plain(rows, linefreq.RATIO, 3)))
        assert got.columns == [*pages.columns, "n_lines", "n_dropped"]
    assert linefreq.without_boilerplate(spark, pages.limit(0), F.col("source")).count() == 0


def test_counts_of_dropped_lines(spark):
    pages = spark.createDataFrame(rows_of(), "doc_id long, source string, text string")
    got = {r.doc_id: r for r in linefreq.without_boilerplate(spark, pages, F.col("source"), least_pages=5, report=True).collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (6, 3) and (got[202].n_lines, got[202].n_dropped) == (0, 0) and got[200].n_dropped == 0


def test_hosts_of_urls(spark):
    pages = spark.createDataFrame([(i, f"http://Site.example/{i}", f"menu\ntext {i}") for i in range(8)], "page_id long, url string, text string")
    got = linefreq.without_boilerplate(spark, pages, linefreq.url_host("url")).collect()
    assert all(r.text == f"text {r.page_id}" for r in got)


def test_names_of_a_report_that_are_taken(spark):
    pages = spark.createDataFrame([(i, "s", f"menu\nline {i}", "mine", 7) for i in range(6)], "doc_id long, source string, text string, n_lines string, n_dropped int")
    got = linefreq.without_boilerplate(spark, pages, F.col("source"), report=True)
    assert got.columns == [*pages.columns, "n_lines_", "n_dropped_"]
    assert {tuple(r)[1:] for r in got.drop("doc_id", "text").collect()} == {("mine", 7, 2, 1)}


def test_many_boilerplate_lines_by_hash_set(spark):
    menu = [f"item {i}" for i in range(linefreq.FEW_LINES + 20)]
    rows = [(i, "s", "\n".join([*menu, f"line {i}", "", *menu])) for i in range(10)]
    got = linefreq.without_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"), F.col("source"))
    assert {(r.doc_id, r.text) for r in got.collect()} == {(i, f"line {i}\n") for i in range(10)}
