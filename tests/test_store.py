"""Stores: commits that count as a whole, parts that are written only if changed."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsloom.operators.state import update_discovered
from newsloom.plans import run
from newsloom.sources.state import DISCOVERED, RECORDS
from newsloom.sources.store import Change, Conflict, Store, bucket, update_buckets

FOUND = "domain string, source string, via string, title string, selected_at timestamp, ord long"
AT = dt.datetime(2026, 9, 29)


def found(spark, domains):
    return spark.createDataFrame([(d, "s", "はてブ検索", f"t{i}", AT, i) for i, d in enumerate(domains)], FOUND)


def counts(store):
    return {r.domain: r["count"] for r in store.read("m", DISCOVERED).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    everyone = [f"d{i}.example" for i in range(200)]
    with Change(store) as change:
        assert len(update_buckets(change, "m", DISCOVERED, found(spark, everyone), "domain", update_discovered)) > 50
    before = store.manifest(1)["tables"]["m"]
    some = ["d1.example", "d1.example", "new.example"]
    wanted = {r[0] for r in found(spark, some).select(bucket("domain")).collect()}
    with Change(store) as change:
        assert set(update_buckets(change, "m", DISCOVERED, found(spark, some), "domain", update_discovered)) == wanted
    after = store.manifest(2)["tables"]["m"]
    assert {p for p in after if after[p] != before.get(p)} == wanted and len(wanted) <= 2
    assert counts(store) == dict.fromkeys(everyone, 1) | {"d1.example": 3, "new.example": 1}
    with Change(store) as change:
        assert update_buckets(change, "m", DISCOVERED, found(spark, []), "domain", update_discovered) == []
    with pytest.raises(ValueError, match="other buckets"), Change(store) as change:
        update_buckets(change, "m", DISCOVERED, found(spark, some), "domain", update_discovered, n=8)
    assert store.latest() == 3 and counts(store)["d1.example"] == 3


def test_two_runs_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with Change(store) as change:
        update_buckets(change, "m", DISCOVERED, found(spark, ["a.example"]), "domain", update_discovered)
    with pytest.raises(Conflict), Change(store) as slow:
        update_buckets(slow, "m", DISCOVERED, found(spark, ["a.example"]), "domain", update_discovered)
        with Change(store) as quick:
            update_buckets(quick, "m", DISCOVERED, found(spark, ["a.example", "a.example"]), "domain", update_discovered)
    assert counts(store) == {"a.example": 3}
    assert sorted(os.listdir(tmp_path / "data")) == sorted({f.split("/")[1] for n in (1, 2) for fs in store.manifest(n)["tables"]["m"].values() for f in fs})


def test_old_commits_are_forgotten(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for _ in range(5):
        with Change(store) as change:
            update_buckets(change, "m", DISCOVERED, found(spark, ["a.example"]), "domain", update_discovered)
            change.file("f", "text")
    store.vacuum(2)
    assert store.commits() == [4, 5] and counts(store) == {"a.example": 5}
    assert sum("parquet" in f for _, _, files in os.walk(tmp_path / "data") for f in files if not f.startswith(".")) == 2


def test_names_and_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert store.latest() == 0 and store.read("m", DISCOVERED).count() == 0
    with pytest.raises(ValueError, match="names of parts"), Change(store) as change:
        change.put("x", spark.range(2), F.lit("a b"))
    with Change(store) as change:
        assert change.put("x", spark.range(0), F.lit("a")) == []
    assert store.read("x", "id long").count() == 0


def record(title, days):
    at = AT - dt.timedelta(days=days)
    return (title, f"https://a.example/{title}-{days}", "A", "RSS", "A", "", "a.example", "ja", 0.5, at, at, [("AI", ["AI"])], "AI", [], 1)


def test_days_are_dropped_whole(spark, tmp_path):
    store, now = Store(spark, str(tmp_path)), AT.replace(tzinfo=dt.timezone.utc)
    for days in (9, 8, 7, 3, 0):
        with Change(store) as change:
            run.keep_days(change, spark.createDataFrame([record("日本", days), record("english", days)], RECORDS), now - dt.timedelta(days=days))
    assert sorted(store.manifest(5)["tables"]["items"]) == ["2026-09-22", "2026-09-26", "2026-09-29", "once"]
    rows = store.read("items", RECORDS).collect()
    assert sorted((r.title, (AT - r.selected_at).days) for r in rows) == [("english", 0), ("日本", 0), ("日本", 3), ("日本", 7)]
    assert store.manifest(5)["tables"]["items"]["2026-09-26"] == store.manifest(4)["tables"]["items"]["2026-09-26"]


@pytest.mark.parametrize("step", ["put", "file", "rename", "commit"])
def test_a_failure_between_any_two_writes_leaves_all_as_it_was(spark, tmp_path, monkeypatch, step):
    """The n-th write of a run fails, for every n: tables and files are those of the run before."""
    from newsloom.sources import store as module

    store = Store(spark, str(tmp_path / "state"))

    def once(text):
        with Change(store) as change:
            update_buckets(change, "m", DISCOVERED, found(spark, ["a.example"]), "domain", update_discovered)
            change.put("items", spark.createDataFrame([record("日本", 0)], RECORDS), F.lit("d"))
            change.file("feed.xml", text)
            change.file("index.html", text)
        store.publish(str(tmp_path))

    once("first")
    owner, name = {"put": (Change, "put"), "file": (Change, "file"), "rename": (module.Files, "rename"), "commit": (Change, "_commit")}[step]
    real, seen = getattr(owner, name), []
    for n in (1, 2):
        if step in ("rename", "commit") and n == 2:
            break
        seen.clear()

        def failing(self, *args, n=n, **kw):
            seen.append(1)
            if len(seen) == n:
                raise OSError("gone")
            return real(self, *args, **kw)

        monkeypatch.setattr(owner, name, failing)
        with pytest.raises(OSError):
            once("second")
        monkeypatch.setattr(owner, name, real)
        assert store.latest() == 1 and counts(store) == {"a.example": 1} and store.read("items", RECORDS).count() == 1
        store.publish(str(tmp_path))
        assert (tmp_path / "feed.xml").read_text() == (tmp_path / "index.html").read_text() == "first"
        assert len(os.listdir(tmp_path / "state" / "data")) == 1  # what the failed run wrote is gone
    once("second")
    assert counts(store) == {"a.example": 2} and (tmp_path / "feed.xml").read_text() == "second"
