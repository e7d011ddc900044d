"""Membership filters of links: nothing that was put in is missed, whatever they are added up from."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import seen
from newsloom.operators.seen import blocks_for, day_filters, merged_filter, unseen_by_filter, with_possible
from newsloom.operators.state import unseen


def links(spark, first, n):
    return spark.range(first, first + n).select("id", (F.col("id") % 3).alias("day"), F.concat(F.lit("https://a.example/"), "id").alias("link"))


@pytest.mark.parametrize("bound", [seen.BROADCAST_BLOCKS, 0])
def test_nothing_is_missed_and_little_is_looked_up(spark, monkeypatch, bound):
    monkeypatch.setattr(seen, "BROADCAST_BLOCKS", bound)
    old, blocks = links(spark, 0, 20000), blocks_for(20000)
    assert blocks == 8
    by_day = day_filters(old, "day", "link", blocks)
    whole = merged_filter(by_day, blocks)
    assert with_possible(old, "link", whole, blocks).where("NOT possibly_seen").count() == 0
    wrong = with_possible(links(spark, 10**6, 20000), "link", whole, blocks).where("possibly_seen").count()
    assert 0 < wrong < 400
    both = links(spark, 19000, 3000)
    assert sorted(unseen_by_filter(both, old, whole, blocks).collect()) == sorted(unseen(both, old).collect())
    one_day = merged_filter(by_day.where("day = 1"), blocks)
    found = with_possible(old, "link", one_day, blocks)
    assert found.where("day = 1 AND NOT possibly_seen").count() == 0 and found.where("day <> 1 AND possibly_seen").count() < 300


def test_folding_equals_a_smaller_filter(spark):
    old = links(spark, 0, 5000)
    large, small = day_filters(old, "day", "link", 16), day_filters(old, "day", "link", 4)
    rows = lambda df: sorted((r.block, bytes(r.bits)) for r in df.collect())
    assert rows(merged_filter(large, 4)) == rows(merged_filter(small, 4))


def test_odd_links(spark):
    """Null and blank links are never seen, repeated rows stay repeated, columns keep their names, tables may be empty."""
    schema = "link string, bits int, block int"
    old = spark.createDataFrame([("https://www.a.example/x/?utm_source=1", 1, 1), (None, 2, 2), ("", 3, 3)], schema)
    whole = merged_filter(day_filters(old, "block", "link", 1), 1)
    rows = spark.createDataFrame([("http://a.example/x", 4, 4), (None, 5, 5), ("", 6, 6), ("https://b.example", 7, 7), ("https://b.example", 7, 7), ("x" * 100000, 8, 8)], schema)
    got = unseen_by_filter(rows, old, whole, 1)
    assert got.columns == ["link", "bits", "block"]
    assert sorted(r.bits for r in got.collect()) == sorted(r.bits for r in unseen(rows, old).collect()) == [5, 6, 7, 7, 8]
    none = merged_filter(day_filters(old.limit(0), "block", "link", 1), 1)
    assert unseen_by_filter(rows, old.limit(0), none, 1).count() == 6 and unseen_by_filter(rows.limit(0), old, whole, 1).count() == 0


def test_new_links_are_not_shuffled(spark):
    old = links(spark, 0, 100)
    plan = with_possible(links(spark, 0, 10), "link", merged_filter(day_filters(old, "day", "link", 1), 1), 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
