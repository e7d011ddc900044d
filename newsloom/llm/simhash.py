"""SimHash near-duplicate groups through an inverted index over positional bytes, with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most `distance` bits differ in at
most that many bytes, so they share at least 8 - distance positional bytes: the guaranteed minimum. An
index of single bytes would have a 256th of all fingerprints in each posting, so a posting is of more:
the eight positions are cut into distance + 2 runs, and every distinct fingerprint is posted under the
bytes of each two runs. At least two runs of a linked pair agree, so it meets.

In a posting the shared positional bytes of each pair are tallied, those of the posting among them.
Pairs below the guaranteed minimum are out; the others are verified by their bits. A posting of more
than GROUP fingerprints is posted again, under each set of 8 - distance bytes that holds its own: a
linked pair shares one of these too, and with distance 2 such a posting leaves two bytes open, so it
can't hold more than 65,536 fingerprints, whatever the table's size. Beyond GROUP members look their
possible partners up, in proportion to their number. Copies of a text share one fingerprint and never
meet as pairs. A posting yields the edges of a spanning star for each of its linked groups, at most one
per member, and never its pairs.

Results for odd input: a null text counts as an empty one (fingerprint zero); very long texts are hashed
a slice at a time; a bit set in exactly half of the hashes is 0; rows with a null id get a fingerprint and
the smallest id of their component, or null if none has one; repeated rows are returned as often as they
come; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import sized, table, written

SEED = 42
SLICE = 1 << 16
BLOCK_NODES = 1_000_000
#: Up to so many members a posting is tallied pair by pair, about TALLY_PAIRS at a time.
GROUP = 2_048
TALLY_PAIRS = 1 << 18


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash over the XXH64 of all word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and \x09-\x0D and \x20 only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        ones += np.unpackbits(hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def mask_of(positions) -> int:
    """The mask of these byte positions, as a signed long."""
    return int(np.array([0xFF if p in positions else 0 for p in range(8)], np.uint8).view(np.int64)[0])


def posted_positions(distance: int) -> list[tuple[int, ...]]:
    """The positions of each two of distance + 2 runs of bytes."""
    runs = np.array_split(np.arange(8), distance + 2)
    return [tuple(int(p) for run in two for p in run) for two in combinations(runs, 2)]


def narrower_positions(positions: tuple[int, ...], distance: int) -> list[tuple[int, ...]]:
    """The sets of 8 - distance positions that hold these."""
    rest = [p for p in range(8) if p not in positions]
    return [tuple(sorted(positions + more)) for more in combinations(rest, 8 - distance - len(positions))]


def tallied(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The linked pairs of a posting, as two arrays of places, and how many pairs the tally retained."""
    n = len(members)
    rows = max(1, TALLY_PAIRS // n)
    first, second, retained = [], [], 0
    for at in range(0, n, rows):
        differ = members[at : at + rows, None] ^ members[None, at:]
        shared = (differ[..., None].view(np.uint8) == 0).sum(axis=-1)
        i, j = np.nonzero(np.triu(shared >= 8 - distance, 1))
        retained += len(i)
        near = np.bitwise_count(differ[i, j].view(np.uint64)) <= distance
        first.append(i[near] + at)
        second.append(j[near] + at)
    return np.concatenate(first), np.concatenate(second), retained


def looked_up(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for ascending members that differ in few bits: each looks for those it may be linked to."""
    free = [b for b in range(64) if ((members[0] ^ members) >> b & 1).any()]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for flip in (sum(1 << b for b in bits) for k in range(1, distance + 1) for bits in combinations(free, k)):
        wanted = (members.view(np.uint64) ^ np.uint64(flip)).view(np.int64)
        at = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
        found = np.flatnonzero((members[at] == wanted) & (members < wanted))
        first.append(found)
        second.append(at[found])
    return np.concatenate(first), np.concatenate(second)


def posting_stars(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one posting as (member, smallest linked member), by union of verified pairs."""
    members = np.sort(members)
    first, second = looked_up(members, distance) if len(members) > GROUP else tallied(members, distance)[:2]
    own = np.arange(len(members))
    label = own.copy()
    while True:
        least = label.copy()
        np.minimum.at(least, second, label[first])
        np.minimum.at(least, first, label[second])
        least = least[least]
        if (least == label).all():
            break
        label = least
    follows = label != own
    return members[follows], members[label[follows]]


def posted(fingerprints: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """(fp, which, held): each fingerprint under its bytes at these positions."""
    entries = [F.struct(F.lit(mask_of(p)).alias("which"), F.col("fp").bitwiseAND(F.lit(mask_of(p))).alias("held")) for p in positions]
    return fingerprints.select("fp", F.explode(F.array(*entries)).alias("entry")).select("fp", "entry.which", "entry.held")


def star_edges(spark: SparkSession, fingerprints: DataFrame, distance: int) -> DataFrame:
    """(src, dst): links between distinct fingerprints, dst the smaller one of a spanning star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [posting_stars(np.asarray(m, np.int64), distance) for m in batch.column(0).to_pylist()]
            src, dst = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    def stars(postings: DataFrame) -> DataFrame:
        gathered = postings.groupBy("which", "held").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        return gathered.select("members").mapInArrow(run, "src long, dst long")

    wide = posted_positions(distance)
    postings = posted(fingerprints, wide)
    large = written(spark, postings.groupBy("which", "held").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("which", "held"), "large")
    if large.limit(1).count() == 0:
        return stars(postings).distinct()
    keys = sized(large)
    again = None
    for positions in wide:
        of = postings.where(F.col("which") == F.lit(mask_of(positions))).join(keys, ["which", "held"], "left_semi").select("fp")
        narrow = posted(of, narrower_positions(positions, distance))
        again = narrow if again is None else again.unionByName(narrow)
    small = postings.join(keys, ["which", "held"], "left_anti")
    return stars(small).unionByName(stars(again.distinct())).distinct()


def block_stars(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) from every node to the smallest one that its block of edges joins it to.

    Blocks hold about BLOCK_NODES nodes, whatever the table's size, and their stars connect what the
    edges do: a group that many postings have linked keeps one edge per member in each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(node: int) -> int:
            while (above := up.setdefault(node, node)) != node:
                up[node] = up[above]
                node = up[node]
            return node

        def stars() -> pa.RecordBatch:
            found = [(node, least) for node in list(up) if (least := root(node)) != node]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            if len(up) > BLOCK_NODES:
                yield stars()
                up.clear()
        yield stars()

    return edges.mapInArrow(run, "src long, dst long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes with an edge.

    First large blocks of edges are cut down to stars. Every round then takes the least
    root among a node's neighbours and the root's own root, and is written to the shared folder; it
    ends when no root changes.
    """
    found = written(spark, edges, "edges")
    blocks = max(1, -(-found.count() // BLOCK_NODES))
    kept = written(spark, block_stars(found.coalesce(blocks)), "stars")
    links = written(spark, kept.union(kept.select("dst", "src")).distinct(), "links")
    roots = links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("root"))
    roots = written(spark, roots, "roots")
    while True:
        near = links.join(roots, links.dst == roots.node).groupBy("src").agg(F.min("root").alias("near"))
        stepped = roots.join(near, roots.node == near.src, "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = stepped.join(above, stepped.root == above.up, "left").select("node", "was", F.least("root", "up_root").alias("root"))
        after = written(spark, jumped, "roots")
        roots = after.select("node", "root")
        if after.where("root <> was").limit(1).count() == 0:
            return roots


def near_duplicate_groups(
    spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = 2
) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the smallest id that links reach."""
    rows = written(spark, with_fingerprints(docs, id_column, text_column, width), "fingerprints")
    classes = written(spark, rows.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    roots = components(spark, star_edges(spark, classes.select("fp"), distance))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return rows.join(named, rows.fp == named.class_fp).select("id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(spark, table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
