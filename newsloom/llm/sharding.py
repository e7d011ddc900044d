"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

A partial partition is a vector of sums, one for each shard, with what lies in each. Differencing
starts with one partial partition per group and again and again takes the two with the largest spread
and adds them in opposite order, the fullest to the emptiest. It doesn't matter where partial
partitions come from, so it works in levels: groups are dealt by a hash into buckets of bounded size,
each bucket is differenced by itself to one partial partition, and these are differenced in their
turn, `fan` at a time, until one is left.

Groups are rows with equal texts, told apart by SHA-256. Slots number the rows of a shard from 0: rows
are numbered in parts of bounded size, each of which begins where the parts before it end. Rows are dealt
into parts by their place as well, so that no row that repeats fills one.

Results for odd input: a null text has no bytes and belongs with empty texts; a very long text is a group
like others; groups of equal weight are taken in the order of their hashes; rows with null ids and repeated
rows are placed like others, and share their text's shard; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import table, written

SHARDS = 24
ROW_BYTES = 8
BUCKET_GROUPS = 20_000
FAN = 1_000
PART_ROWS = 100_000


def difference(partials: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition and each of its parts: the shard that the part goes to."""
    left: list[int | None] = []  # a tree of parts for each shard: leaves are below `leaves`
    right: list[int] = []
    leaves = len(partials) * shards

    def joined(a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        left.append(a)
        right.append(b)
        return leaves + len(left) - 1

    heap = []
    for i, sums in enumerate(partials):
        slots = sorted(((s, i * shards + p if s else None) for p, s in enumerate(sums)), key=lambda x: -x[0])
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    count = len(partials)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        slots = sorted(((x + y, joined(m, n)) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        least = slots[-1][0]
        slots = [(s - least, n) for s, n in slots]
        heapq.heappush(heap, (-slots[0][0], count, slots))
        count += 1
    out = [[p % shards for p in range(shards)] for _ in partials]  # an empty part may go anywhere
    for shard, (_, node) in enumerate(heap[0][2] if heap else []):
        todo = [] if node is None else [node]
        while todo:
            n = todo.pop()
            if n < leaves:
                out[n // shards][n % shards] = shard
            else:
                todo += (left[n - leaves], right[n - leaves])
    return out


def balanced_groups(spark: SparkSession, groups: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS, fan: int = FAN) -> DataFrame:
    """(key, shard) for groups (key, weight)."""
    buckets = max(1, -(-groups.count() // bucket_groups))

    def bucket_parts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "key"], ascending=[False, True], kind="stable")
        found = difference([[w] + [0] * (shards - 1) for w in rows["weight"].tolist()], shards)
        return rows.assign(part=[f[0] for f in found])

    dealt = groups.select("key", "weight", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    kind = groups.schema["key"].dataType.simpleString()
    parts = dealt.groupBy("bucket").applyInPandas(bucket_parts, f"key {kind}, weight long, bucket long, part int")
    parts = written(spark, parts, "parts")
    while buckets > 1:
        buckets = -(-buckets // fan)
        sums = parts.groupBy("bucket", "part").agg(F.sum("weight").alias("weight"))

        def above(rows: pd.DataFrame) -> pd.DataFrame:
            wide = rows.pivot(index="bucket", columns="part", values="weight").reindex(columns=range(shards)).fillna(0).astype("int64").sort_index()
            found = difference(wide.to_numpy().tolist(), shards)
            return pd.DataFrame([(b, p, s) for b, to in zip(wide.index, found, strict=True) for p, s in enumerate(to)], columns=["bucket", "part", "to"])

        moved = sums.withColumn("super", F.floor(F.col("bucket") / fan)).groupBy("super").applyInPandas(above, "bucket long, part int, to int")
        joined = parts.join(moved, ["bucket", "part"])
        parts = written(spark, joined.select("key", "weight", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("to").alias("part")), "parts")
    return parts.select("key", F.col("part").alias("shard"))


def with_slots(spark: SparkSession, placed: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """placed (a written table with a column shard) with slot: 0, 1, 2, ... within each shard."""
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    split = placed.withColumn("split", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-most // part_rows)))))
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("split")) - F.col("held")  # a row per split
    begin = split.groupBy("shard", "split").agg(F.count("*").alias("held")).select("shard", "split", before.alias("begin"))
    number = F.row_number().over(Window.partitionBy("shard", "split").orderBy(*order)) - 1
    return split.withColumn("number", number).join(begin, ["shard", "split"]).withColumn("slot", F.col("begin") + F.col("number")).drop("split", "number", "begin")


def shards_by_bytes(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs; equal texts share a shard."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        F.monotonically_increasing_id().alias("row"),  # fixed once written; tells repeated rows apart
    )
    rows = written(spark, rows, "sizes")
    groups = written(spark, rows.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    placed = rows.join(balanced_groups(spark, groups, shards), "key").drop("key")
    return with_slots(spark, written(spark, placed, "placed"), ["id", "size", "text_crc32", "row"]).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards_by_bytes(spark, table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
