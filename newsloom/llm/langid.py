"""Language identification by multinomial naive Bayes over hashed character n-grams.

Learning counts every n-gram of every labelled text: tasks add up their own counts, Spark sums them by
language and bucket. A table of log probabilities has BUCKETS rows and a column per language. Languages
are dealt into blocks of about BLOCK_LANGUAGES, each a table that is broadcast; a text meets one after the
other and carries its best language and the sum of the odds along. Scoring handles texts in slices: one
array of code points, one of bucket numbers per n-gram order, rows of the table gathered and added up per
text.

Results for odd input: a text that is null or has no letter is `und` with score 0, and so is every
text if nothing could be learned; of languages with equal odds the first in order is taken; null labels
aren't learned from; very long texts are scored whole, piece by piece, and their pieces' sums added up; repeated rows count as
often as they come; an empty table gives an empty one; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import is_held_out, table, written

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
BLOCK_LANGUAGES = 64
UNKNOWN = "und"
#: Characters handled at once, which bounds the memory of a task.
SLICE_CHARS = 250_000
#: Log probabilities that are gathered at once.
GATHERED = 8_000_000

#: The best language so far, its log odds, and the logarithm of the sum of all odds.
FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("best", T.DoubleType()), T.StructField("whole", T.DoubleType())])
Block = tuple[list[str], np.ndarray, np.ndarray]


def pieces_of(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Lots of (text, piece, n-grams that begin in it as its own), about SLICE_CHARS together; a long text has several pieces.

    A piece goes on for what its last n-grams need of the next one.
    """
    lot: tuple[list[int], list[str], list[int]] = ([], [], [])
    for i, text in enumerate(texts):
        padded = f" {text.lower()} "
        for first in range(0, len(padded), SLICE_CHARS):
            piece = padded[first : first + SLICE_CHARS + max(ORDERS) - 1]
            for column, value in zip(lot, (i, piece, min(SLICE_CHARS, len(padded) - first)), strict=True):
                column.append(value)
            if sum(lot[2]) >= SLICE_CHARS:
                yield lot
                lot = ([], [], [])
    if lot[0]:
        yield lot


def grams(pieces: list[str], own: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers for each order at each position of the joined pieces, and where each piece begins.

    Where an n-gram would leave its piece, or isn't the piece's own, the number is BUCKETS, which has no weight.
    """
    begin = np.concatenate(([0], np.cumsum([len(t) for t in pieces])))
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    out, mixed = [], np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        tail = points[order - 1 :]
        mixed = (mixed[: len(tail)] ^ tail) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if order in ORDERS:
            numbers = np.full(len(points), BUCKETS, np.int32)
            numbers[: len(mixed)] = (mixed * np.uint32(0x85EBCA77)) >> np.uint32(16)
            for back in range(1, order):
                numbers[begin[1:] - back] = BUCKETS
            for at, n, end in zip(begin, own, begin[1:], strict=False):
                if at + n < end:
                    numbers[at + n : end] = BUCKETS
            out.append(numbers)
    return out, begin


def text_odds(texts: list[str], priors: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log odds of each text and language; what is gathered at once is bounded by GATHERED, whatever the texts and languages."""
    sums = np.tile(priors, (len(texts), 1)).astype(np.float64)
    step = max(1, GATHERED // max(1, logs.shape[1]))
    for owners, pieces, own in pieces_of(texts):
        numbers, begin = grams(pieces, own)
        for n in numbers:
            for at in range(0, len(n), step):
                first = np.searchsorted(begin, at, "right") - 1
                edges = np.maximum(begin[first : np.searchsorted(begin, min(at + step, len(n)), "left")], at) - at
                np.add.at(sums, owners[first : first + len(edges)], np.add.reduceat(logs[n[at : at + step]], edges, axis=0, dtype=np.float64))
    return sums


def slices_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(texts.cast(pa.string())), 0).to_pylist()):
        held += size
        if held >= SLICE_CHARS:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def learn(spark: SparkSession, labelled: DataFrame, text_column: str = "text", label_column: str = "lang", block_languages: int = BLOCK_LANGUAGES) -> list[Block]:
    """Blocks of languages, log priors, and log probabilities (BUCKETS + 1 rows; the last is zero)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # the last entry: number of texts
        for batch in batches:
            for first, last in slices_of(batch.column(1)):
                labels, texts = (batch.column(c).slice(first, last - first).to_pylist() for c in (0, 1))
                for label in set(labels):
                    of = [t for t, x in zip(texts, labels, strict=True) if x == label]
                    held = sums.setdefault(label, np.zeros(BUCKETS + 2, np.int64))
                    held[-1] += len(of)
                    for _, pieces, own in pieces_of(of):
                        for numbers in grams(pieces, own)[0]:
                            held += np.bincount(numbers, minlength=BUCKETS + 2)
        for label, held in sums.items():
            held[BUCKETS] = 0
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(held[at])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(label_column).alias("lang"), F.col(text_column).alias("text")).dropna()
    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = written(spark, summed, "grams")
    known = summed.where(F.col("bucket") == BUCKETS + 1).agg(F.count("*").alias("languages"), F.sum("n").alias("texts")).first()
    blocks = -(-known.languages // block_languages)
    dealt = summed.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks))) if blocks > 1 else summed.withColumn("block", F.lit(0))
    found = (block_of(dealt.where(F.col("block") == i).toArrow(), known.texts) for i in range(blocks))  # BUCKETS + 2 rows a language at most
    return [block for block in found if block[0]]


def block_of(found: pa.Table, all_texts: int) -> Block:
    languages = sorted(pc.unique(found["lang"]).to_pylist())
    counts = np.zeros((BUCKETS + 2, len(languages)))
    counts[found["bucket"].to_numpy(), pc.index_in(found["lang"], pa.array(languages, pa.string())).to_numpy()] = found["n"].to_numpy()
    texts, counts = counts[-1], counts[:BUCKETS] + SMOOTHING
    logs = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    logs[:-1] = np.log(counts / counts.sum(axis=0))
    return languages, np.log(texts / all_texts), logs


def block_scorer(spark: SparkSession, block: Block):
    """A UDF (text, FOUND so far) -> FOUND."""
    sent = spark.sparkContext.broadcast(block)

    @F.arrow_udf(FOUND)
    def predict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        languages, priors, logs = sent.value
        for texts, before in batches:
            names, best, whole = before.field("lang").to_pylist(), before.field("best").to_numpy(zero_copy_only=False).copy(), before.field("whole").to_numpy(zero_copy_only=False).copy()
            for first, last in slices_of(texts):
                part = pc.fill_null(texts.slice(first, last - first).cast(pa.string()), "").to_pylist()
                sums = text_odds(part, priors, logs)
                top = sums.max(axis=1)
                whole[first:last] = np.logaddexp(whole[first:last], top + np.log(np.exp(sums - top[:, None]).sum(axis=1)))
                for i, (at, odds) in enumerate(zip(sums.argmax(axis=1).tolist(), top.tolist(), strict=True), first):
                    if names[i] is None or (-odds, languages[at]) < (-best[i], names[i]):
                        names[i], best[i] = languages[at], odds
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best), pa.array(whole)], ["lang", "best", "whole"])

    return predict.asNondeterministic()  # so that it isn't run again for each use of its fields


def with_language(spark: SparkSession, docs: DataFrame, blocks: list[Block], column: str, text_column: str = "text") -> DataFrame:
    """docs with a column (lang, score), score the posterior of the language."""
    none = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(float("-inf")).alias("best"), F.lit(float("-inf")).alias("whole"))
    out = docs.withColumn(column, none)
    for i, block in enumerate(blocks):
        if i:
            out = written(spark, out, "languages")
        out = out.withColumn(column, block_scorer(spark, block)(F.col(text_column), F.col(column)))
    known = F.col(f"{column}.lang").isNotNull() & F.coalesce(F.col(text_column).cast("string").rlike("\\p{L}"), F.lit(False))
    lang = F.when(known, F.col(f"{column}.lang")).otherwise(F.lit(UNKNOWN))
    score = F.when(known, F.exp(F.col(f"{column}.best") - F.col(f"{column}.whole"))).otherwise(F.lit(0.0))
    return out.withColumn(column, F.struct(lang.alias("lang"), score.alias("score")))


def learn_from(spark: SparkSession, docs: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", folds: int = 4) -> list[Block]:
    """What the rows of docs that aren't held out teach."""
    return learn(spark, docs.where(~is_held_out(id_column, folds)), text_column, label_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", is_held_out("doc_id", 4).alias("held_out"), "text")
    found = with_language(spark, rows, learn_from(spark, docs), "found")
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
