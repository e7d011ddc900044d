"""Quality scores by Bradley-Terry ranking of preference pairs.

A document's strength is linear in features of its text: shares of character classes, repetition of
words, word pairs and lines, word and line lengths, compressibility. A text with label 1 is preferred
to one with label 0, and the weights minimise the logistic loss on feature differences of such pairs.

The loss is the mean over every pair of a good and a bad text among all labelled rows of the allowed folds. A pair's
share depends on its two strengths alone, so a Newton step needs of each label how many texts, and what sum of
their features, lie in each of BINS narrow bins of strength: one aggregation of all rows for these, and one for the second
moments, weighted by bin. The threshold is the strength at the quantile that leaves as large a share of all learned rows
above as has label 1, exactly; scores are the strength around it, squeezed so that it scores exactly 0.7.
Texts are measured whole, where they are, once; only sums and counts come to the driver, a few for each partition.

Results for odd input: a null text is an empty one, and has a score as well; very long texts are measured
whole, one at a time; labels that are null, or whose document is missing, aren't learned from; repeated
rows are scored each; equal texts have equal scores, and a score at the threshold is above it; without
labels of both kinds every score is 0.5; an empty table gives an empty one; columns that aren't named are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import is_held_out, sized, table, written

#: Bins of strength; they are even in its arsinh, which is taken up to REACH: about 0.03 wide where strengths are 3.
BINS, REACH = 1024, 6.0
#: At most so many tasks hand their sums to the driver.
PARTS = 128
#: Strengths lie within this.
BOUND = 1e6
#: Up to so many values around a quantile are looked at one by one.
FEW = 4096
PAIRS_EACH = 8
PENALTY = 1e-3
LIMIT = 0.7
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b"!?", b",;:", b"'\"", b"#$%&*+<=>@^_`~", b"|/\\", b"()[]{}", bytes(range(128, 256))]
OF_CLASS = np.array([[b in c for c in CLASSES] for b in range(256)], float)


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    n, w = max(1, len(data)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    held = [
        *(np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ OF_CLASS / n),
        np.log1p(len(data)),
        len(data) / w,
        len(counts) / w,
        np.log1p(len(counts)) / np.log1p(w),
        max(counts.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(zip(words, words[1:], strict=False))) / w,
        (lengths <= 3).sum() / w,
        (lengths >= 15).sum() / w,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(w / len(lines)),
        len(zlib.compress(data, 1)) / n,
    ]
    return np.array(held, float)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def strengths(self, found: np.ndarray) -> np.ndarray:
        return expanded(found, self.centre, self.spread) @ self.weights

    def scores(self, found: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.full(len(found), 0.5)
        at = (self.strengths(found) - self.threshold) / self.width + np.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def expanded(found: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, within bounds, and their squares."""
    x = np.clip((found - centre) / spread, -6, 6)
    return np.hstack((x, x * x))


def fit(found: np.ndarray, labels: np.ndarray, pairs_each: int = PAIRS_EACH, penalty: float = PENALTY, steps: int = 30) -> Model:
    """Bradley-Terry weights of arrays at hand, by Newton steps on the logistic loss of pairs; tables go through `learn`."""
    centre, spread = (found.mean(axis=0), np.maximum(found.std(axis=0), 1e-9)) if len(found) else (0.0, 1.0)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(centre, spread, np.zeros(0), 0.0, 0.0)
    x = expanded(found, centre, spread)
    order = np.random.default_rng(0)
    n = pairs_each * max(len(good), len(bad))
    pairs = x[order.permutation(np.resize(good, n))] - x[order.permutation(np.resize(bad, n))]
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        won = 1 / (1 + np.exp(-np.clip(pairs @ weights, -40, 40)))
        slope = pairs.T @ (won - 1) / n + penalty * weights
        curve = (pairs * (won * (1 - won))[:, None]).T @ pairs / n + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    strengths = x @ weights
    return Model(centre, spread, weights, float(np.quantile(strengths, 1 - len(good) / (len(good) + len(bad)))), float(strengths.std()) or 1.0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))


def matrix(found: pa.Array) -> np.ndarray:
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1)


def gathered(learned: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What add(features, labels) gives for the batches of a partition, summed up; one array for each, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if len(batch):
                more = add(matrix(batch.column("found")), batch.column("label").to_numpy())
                out = more if out is None else out + more
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    rows = learned.coalesce(PARTS).mapInArrow(run, "part int, sums binary").collect()
    return [np.frombuffer(r.sums, float) for r in sorted(rows)]


def bins_of(strengths: np.ndarray) -> np.ndarray:
    return np.clip((np.arcsinh(strengths) / REACH + 1) * (BINS / 2), 0, BINS - 1).astype(np.int64)


def moments(learned: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """How many good and bad rows, and mean and standard deviation of each feature."""
    first = gathered(learned, lambda x, y: np.hstack(((y == 1).sum(), (y == 0).sum(), x.sum(axis=0))))
    if not first:
        return 0, 0, np.zeros(0), np.ones(0)
    good, bad, *sums = np.sum(first, axis=0)
    centre = np.array(sums) / (good + bad)
    spread = np.sqrt(np.sum(gathered(learned, lambda x, y: ((x - centre) ** 2).sum(axis=0)), axis=0) / (good + bad))
    return int(good), int(bad), centre, np.maximum(spread, 1e-9)


def newton_step(learned: DataFrame, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, penalty: float) -> np.ndarray:
    size = len(weights)

    def binned(found: np.ndarray, labels: np.ndarray) -> np.ndarray:
        x = expanded(found, centre, spread)
        strengths = x @ weights
        at = bins_of(strengths) * 2 + labels
        held = np.column_stack((np.ones(len(x)), strengths, x))
        return np.stack([np.bincount(at, h, BINS * 2) for h in held.T], axis=1).ravel()

    sums = np.sum(gathered(learned, binned), axis=0).reshape(BINS, 2, size + 2)
    (bad, good), (low, high) = (sums[sums[:, k, 0] > 0, k] for k in (0, 1)), (np.flatnonzero(sums[:, k, 0]) for k in (0, 1))
    n = good[:, 0].sum() * bad[:, 0].sum()
    ahead = (good[:, 1] / good[:, 0])[:, None] - (bad[:, 1] / bad[:, 0])[None, :]
    lost = 1 / (1 + np.exp(np.clip(ahead, -40, 40)))
    curved = lost * (1 - lost)
    slope = ((lost.T @ good[:, 0]) @ bad[:, 2:] - (lost @ bad[:, 0]) @ good[:, 2:]) / n + penalty * weights
    of_bin = np.zeros((BINS, 2))
    of_bin[high, 1], of_bin[low, 0] = curved @ bad[:, 0], curved.T @ good[:, 0]

    def second(found: np.ndarray, labels: np.ndarray) -> np.ndarray:
        x = expanded(found, centre, spread)
        return ((x * of_bin[bins_of(x @ weights), labels][:, None]).T @ x).ravel()

    both = good[:, 2:].T @ curved @ bad[:, 2:]
    curve = (np.sum(gathered(learned, second), axis=0).reshape(size, size) - both - both.T) / n + penalty * np.eye(size)
    return np.linalg.solve(curve, slope)


def quantile(learned: DataFrame, strengths_of: Callable[[np.ndarray], np.ndarray], n: int, q: float) -> float:
    """The quantile of all strengths, between two of them as numpy's."""
    place = q * (n - 1)
    wanted = [int(np.floor(place)), int(np.ceil(place))]
    found = []
    for rank in wanted:
        begin, end, before = -BOUND, BOUND, 0  # what is below begin: `before` values
        while True:
            edges = np.linspace(begin, end, FEW + 1)
            edges = np.unique(np.append(edges[:-1], np.nextafter(end, np.inf)))
            counts = np.sum(gathered(learned, lambda x, y, e=edges: np.histogram(strengths_of(x), e)[0].astype(float)), axis=0).astype(np.int64)
            upto = before + np.cumsum(counts)
            k = int(np.searchsorted(upto, rank, side="right"))
            begin, end, before = edges[k], np.nextafter(edges[k + 1], -np.inf), int(upto[k] - counts[k])
            if counts[k] <= FEW or begin >= end:
                break
        if begin >= end:
            found.append(float(begin))
            continue
        inside = gathered_values(learned, strengths_of, begin, end)
        found.append(float(inside[rank - before]))
    return found[0] + (found[1] - found[0]) * (place - wanted[0])


def gathered_values(learned: DataFrame, strengths_of: Callable[[np.ndarray], np.ndarray], begin: float, end: float) -> np.ndarray:
    """The strengths within these bounds, ascending: the caller knows that they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = strengths_of(matrix(batch.column("found"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(x[(x >= begin) & (x <= end)])], ["strength"])

    return np.sort(learned.coalesce(PARTS).mapInArrow(run, "strength double").toArrow()["strength"].to_numpy())


def learn(learned: DataFrame, penalty: float = PENALTY, steps: int = 20) -> Model:
    """The model of all rows of learned (label, found), a written table."""
    good, bad, centre, spread = moments(learned)
    if not good or not bad:
        return Model(centre, spread, np.zeros(0), 0.0, 0.0)
    weights = np.zeros(2 * len(centre))
    for _ in range(steps):
        step = newton_step(learned, centre, spread, weights, penalty)
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    model = Model(centre, spread, weights, 0.0, 1.0)
    n, strengths = good + bad, model.strengths
    mean = np.sum(gathered(learned, lambda x, y: strengths(x).sum(keepdims=True)), axis=0)[0] / n
    square = np.sum(gathered(learned, lambda x, y: ((strengths(x) - mean) ** 2).sum(keepdims=True)), axis=0)[0]
    return Model(centre, spread, weights, quantile(learned, strengths, n, 1 - good / n), float(np.sqrt(square / n)) or 1.0)


def scorer(spark: SparkSession, model: Model):
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            yield pa.array(sent.value.scores(matrix(found)), pa.float64())

    return score.asNondeterministic()  # so that it isn't run again for each use


def quality_scores(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", folds: int = 4
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    rows = docs.select(F.col(id_column).alias("id"), is_held_out(id_column, folds).alias("held_out"), feature_column(text_column).alias("found"))
    rows = written(spark, rows, "features")
    allowed = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(~is_held_out("id", folds)).where("label IN (0, 1)")
    learned = written(spark, rows.join(sized(allowed), "id").select("label", "found"), "learned")
    scored = rows.select("id", "held_out", scorer(spark, learn(learned))("found").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
