"""Hard negatives: for anchors and their nearest rows of the same label, near rows of other labels within a band of scores.

Scores are inner products of whole numbers. All vectors are turned by one orthogonal matrix, the principal axes
of their second moments, so that leading components hold most of a product. For a row and an anchor the products
of the leading components are added up in STAGES; what the others can still add is at most the product of the norms of
the two rests (Cauchy-Schwarz), plus a slack for rounding, which comes from how far the matrix is from orthogonal and
from the length of a sum. A pair that can't come among an anchor's best any more, or can't be in its band, is discarded at
that stage. Survivors get their exact integer product, which alone decides. So the axes, fitted to the
FITTED rows with the least hashes of their ids, change what is discarded early but never the result. While more than DENSE
of the pairs are left, as for vectors without leading components, the next components come as products of matrices
too; only what is left after that is looked at pair by pair.

How it runs. Anchors are taken in rounds of bounded size. In a round every task holds the round's anchors (a broadcast
of at most ROUND_BYTES) and reads its rows in blocks against tiles of them; it keeps an anchor's best rows so
far, whose worst one is the threshold for later blocks, and gives them out at its end. New rows
wait until they are half as many as all slots can hold, and are then sorted in. A window then picks the best
of all tasks: first each anchor's positives, at most POSITIVES of them, which are sent out in turn with their bands
for the negatives. A round's result is a table of its own, so a lost executor costs one task's blocks.

Results for odd input: rows with a null id, label or vector, or a component that is null or not finite, take no part,
nor do those with a component whose number is beyond +-2^26, since scores must fit into a long; of rows with equal ids
the one with the least label and vector counts; shorter vectors are filled up with zeros; equal scores
are in the order of ids; an anchor without another row of its label, or a positive without negatives in its
band, gives no rows; an empty table gives an empty one; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import new_path, scratch, table, written

POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Rows that the axes are fitted to, and bytes of anchors that are sent out in a round.
FITTED, ROUND_BYTES = 4096, 16_000_000
#: After which part of the components pairs are looked at; the first one is a product of matrices, and so is the next if more than DENSE of the pairs are left.
STAGES, DENSE = (0.25, 0.5, 1.0), 0.05
#: Rows and anchors that are compared at once, and pairs that are verified at once.
BLOCK, TILE, PAIRS = 512, 1024, 32_768
LARGEST = 1 << 26
NONE = np.iinfo(np.int64).min


# --- rows -----------------------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, id_column: str, label: Column, vector_column: str, scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part, q the vector in whole numbers."""
    v = F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / scale))
    held = rows.where(F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector_column).isNotNull()).where(finite)
    numbered = held.select(F.col(id_column).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), v.cast("array<int>").alias("q")).alias("row"))
    return numbered.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q")


def padded(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(size) - F.size("q"))))


def axes_of(rows: DataFrame, size: int, fitted: int = FITTED) -> np.ndarray:
    """The principal axes of second moments of at most `fitted` rows, as columns, the longest first."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fitted).select("q").toArrow()
    q = matrix(sample.column(0).combine_chunks(), size).astype(np.float64)
    return np.linalg.eigh(q.T @ q)[1][:, ::-1] if size else np.zeros((0, 0))


def matrix(vectors: pa.ListArray, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), size).astype(np.int64)


# --- turned vectors and their bounds --------------------------------------------------------------------------


@dataclass
class Turned:
    """Vectors and what bounds their products: turned ones, the norms of their rests after each stage, and their own."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    y: np.ndarray
    rests: list[np.ndarray]
    norms: np.ndarray

    def at(self, part) -> Turned:
        return Turned(self.ids[part], self.labels[part], self.q[part], self.y[part], [r[part] for r in self.rests], self.norms[part])


def stages_of(size: int) -> list[int]:
    return sorted({max(1, int(size * s)) for s in STAGES}) if size else [0]


def turned(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, axes: np.ndarray) -> Turned:
    y = q.astype(np.float64) @ axes
    after = np.sqrt(np.maximum(np.cumsum((y**2)[:, ::-1], 1)[:, ::-1], 0))  # after[k]: the norm of components k and later
    after = np.hstack([after, np.zeros((len(q), 1))])
    return Turned(ids, labels, q, y, [after[:, k] for k in stages_of(q.shape[1])], np.sqrt((q.astype(np.float64) ** 2).sum(1)))


def slack_of(axes: np.ndarray) -> float:
    """What rounding can move a bound by, as a part of the product of two norms."""
    size = len(axes)
    return float(np.linalg.norm(axes @ axes.T - np.eye(size))) + 32 * (size + 1) ** 1.5 * 2.0**-53


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best of each slot: the highest scores, of equals the least ids; in the order of slots."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    begins = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
    place = np.arange(len(slot)) - np.maximum.accumulate(np.where(begins, np.arange(len(slot)), 0)) if len(slot) else slot
    kept = place < most
    return slot[kept], score[kept], ids[kept]


class Search:
    """The best rows so far of each slot: an anchor and a band [low, high] of scores. bands: anchors x (bands of an anchor)."""

    def __init__(self, anchors: Turned, axes: np.ndarray, low: np.ndarray, high: np.ndarray, same_label: bool, most: int):
        self.anchors, self.axes, self.low, self.high, self.same, self.most = anchors, axes, low, high, same_label, most
        self.slack, self.stages = slack_of(axes), stages_of(anchors.q.shape[1])
        self.least = np.full(low.shape, NONE, np.int64)  # the worst of a full slot
        self.highest = np.where(low <= high, high, NONE).max(1)  # of an anchor's bands
        self.merged = tuple(np.zeros(0, np.int64) for _ in range(3))  # slot, score, id
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.seen = self.survived = 0

    @property
    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of the best rows so far; those that wait are merged, and thresholds follow."""
        if self.waiting:
            self.merged = best(*map(np.concatenate, zip(self.merged, *self.waiting, strict=True)), self.most)
            self.waiting = []
            slot, first, n = np.unique(self.merged[0], return_index=True, return_counts=True)
            full = n == self.most
            self.least.reshape(-1)[slot[full]] = self.merged[1][first[full] + self.most - 1]
        return self.merged

    def wanted(self, part) -> np.ndarray:
        """The least score of use in each band of these anchors."""
        return np.where(self.low[part] <= self.high[part], np.maximum(self.low[part], self.least[part]), np.iinfo(np.int64).max)

    def tiles(self, rows: Turned) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows and of anchors that are compared at once: those of a label, or all."""
        for label in np.unique(rows.labels) if self.same else [None]:
            mine = np.flatnonzero((rows.labels == label) | (not self.same))
            theirs = np.flatnonzero((self.anchors.labels == label) | (not self.same))
            yield from ((mine, theirs[at : at + TILE]) for at in range(0, len(theirs), TILE))

    def add(self, rows: Turned) -> None:
        """Look at a block of rows."""
        for mine, tile in self.tiles(rows):
            r, a, wanted, highest = rows.at(mine), self.anchors.at(tile), self.wanted(tile).min(1), self.highest[tile]
            fits = (r.labels[:, None] == a.labels[None, :]) == self.same
            self.seen += fits.sum()
            part, k = 0, 0
            for stage, more in enumerate(self.stages):  # noqa: B007
                part, k = part + r.y[:, k:more] @ a.y[:, k:more].T, more
                rest = r.rests[stage].max() * a.rests[stage] + self.slack * r.norms.max() * a.norms + 1e-6  # for any row of the block
                fits &= (part >= wanted - rest) & (part <= highest + rest)
                if fits.sum() <= DENSE * fits.size:
                    break
            ri, ai = np.nonzero(fits)
            for at in range(0, len(ri), PAIRS):
                i, j = ri[at : at + PAIRS], ai[at : at + PAIRS]
                self.verify(r, i, tile[j], part[i, j], stage)

    def verify(self, rows: Turned, ri: np.ndarray, ai: np.ndarray, part: np.ndarray, stage: int) -> None:
        """Look at pairs of rows and anchors; part: their products up to this stage."""
        a, bands = self.anchors, self.low.shape[1]
        other = rows.ids[ri] != a.ids[ai]
        ri, ai, part = ri[other], ai[other], part[other]
        for after in range(stage, len(self.stages)):
            if after > stage:
                new = slice(self.stages[after - 1], self.stages[after])
                part = part + np.einsum("ij,ij->i", rows.y[ri, new], a.y[ai, new])
            rest = rows.rests[after][ri] * a.rests[after][ai] + self.slack * rows.norms[ri] * a.norms[ai] + 1e-6
            kept = (((part + rest)[:, None] >= self.wanted(ai)) & ((part - rest)[:, None] <= self.high[ai])).any(1)
            ri, ai, part = ri[kept], ai[kept], part[kept]
        score = np.einsum("ij,ij->i", rows.q[ri], a.q[ai])
        self.survived += len(ri)
        pair, band = np.nonzero((score[:, None] >= self.wanted(ai)) & (score[:, None] <= self.high[ai]))
        self.waiting.append((ai[pair] * bands + band, score[pair], rows.ids[ri[pair]]))
        if 2 * sum(len(w[0]) for w in self.waiting) >= self.low.size * self.most:
            self.found  # noqa: B018


def searched(spark: SparkSession, rows: DataFrame, anchors: Turned, axes: np.ndarray, low: np.ndarray, high: np.ndarray, same_label: bool, most: int) -> DataFrame:
    """(anchor, band, id, score, place): the best rows of each anchor and band, place from 1."""
    sent = spark.sparkContext.broadcast((anchors, axes, low, high))
    size = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, axes, low, high = sent.value
        search = Search(anchors, axes, low, high, same_label, most)
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
            q = matrix(batch.column(2), size)
            for at in range(0, len(ids), BLOCK):
                part = slice(at, at + BLOCK)
                search.add(turned(ids[part], labels[part], q[part], axes))
        slot, score, found = search.found
        bands = low.shape[1]
        for at in range(0, len(slot), 100_000):
            s = slot[at : at + 100_000]
            columns = [anchors.ids[s // bands], s % bands, found[at : at + 100_000], score[at : at + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["anchor", "band", "id", "score"])

    of_tasks = rows.mapInArrow(run, "anchor long, band long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id"))  # `most` rows of each task
    return of_tasks.withColumn("place", place).where(F.col("place") <= most)


# --- the operator ---------------------------------------------------------------------------------------------


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    is_anchor: Column,
    path: str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    most_percent: int = MOST_PERCENT,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), written at path.

    rows: (id, label, q) as whole_vectors gives them. is_anchor: a condition on id.
    """
    rows = written(spark, rows, "vectors")
    about = rows.agg(F.max(F.size("q")).alias("most"), F.min(F.size("q")).alias("least"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    size = about.most or 0
    if about.least != about.most:
        rows = written(spark, padded(rows, size), "vectors")
    axes = axes_of(rows, size)
    rounds = max(1, -(-about.anchors * (size + 1) * 16 // round_bytes))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for number in range(rounds):
        mine = rows.where(is_anchor & (F.pmod(F.xxhash64("id"), F.lit(rounds)) == number)).toArrow()  # about round_bytes
        ids, labels = (mine.column(c).to_numpy() for c in ("id", "label"))
        anchors = turned(ids, labels, matrix(mine.column("q").combine_chunks(), size), axes)
        open_low, open_high = np.full((len(ids), 1), NONE + 1, np.int64), np.full((len(ids), 1), np.iinfo(np.int64).max, np.int64)
        near = written(spark, searched(spark, rows, anchors, axes, open_low, open_high, True, positives), "positives")
        best_of = near.toArrow()  # at most `positives` rows of each anchor of the round
        low, high = np.full((len(ids), positives), 1, np.int64), np.zeros((len(ids), positives), np.int64)  # empty bands
        at = np.argsort(ids)
        row = at[np.searchsorted(ids[at], best_of["anchor"].to_numpy())] if len(ids) else np.zeros(0, np.int64)
        band, score = best_of["place"].to_numpy().astype(np.int64) - 1, best_of["score"].to_numpy()
        low[row, band], high[row, band] = -((-least_percent * score) // 100), (most_percent * score) // 100
        hard = searched(spark, rows, anchors, axes, low, high, False, negatives)
        named = near.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).cast("long").alias("of_band"))
        joined = hard.join(named, (F.col("anchor") == F.col("anchor_id")) & (F.col("band") == F.col("of_band")))
        out = joined.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        written(spark, out, "negatives", f"{path}/round={number}")
    return spark.read.schema(schema).parquet(*[f"{path}/round={n}" for n in range(rounds)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    with scratch(spark):
        rows = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
        return hard_negatives(spark, rows, F.col("id") % 100 == 0, new_path(spark, "hard-negatives"))


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
