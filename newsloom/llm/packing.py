"""Harmonic packing of token sequences.

Class k holds pieces of which k fit into a sequence: their length is at most capacity // k. A document
is cut so that its pieces fill their classes: as many whole sequences as it has (class 1), then from
what is left again and again the longest piece of some capacity // k, down to `least_piece` tokens;
the last few tokens are a piece of their own class. A bin of class k takes k pieces, whichever they
are, so workers fill bins without knowing of each other: pieces are dealt into buckets of bounded
size, and each (class, bucket) numbers its pieces and cuts the numbers into bins of k.

What is left over in a bucket is fewer than k pieces of each class, a number that depends on the
capacity alone. These few are placed together, longest first into the first bin with room.

Results for odd input: a null text is an empty one, which has the end id alone; very long texts are cut
into many pieces; pieces of equal length are in the order of their ids; rows with null ids and repeated
rows are packed like others, and dealt into buckets by their place as well, so that no row can fill one;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import table, written
from newsloom.llm.tokens import VOCABULARY, encoder_of, slices

CAPACITY = 2048
LEAST_PIECE = 32
END_ID = 1
#: Texts are handled in slices of about so many bytes, with their pieces beside them.
SLICE_BYTES = 3_000_000
#: About so many pieces are numbered together.
BUCKET_PIECES = 200_000
#: Bins of a class and bucket have numbers of so many bits; a bucket has fewer pieces, since repeated rows are dealt apart.
BIN_BITS = 26
#: Equal rows are told apart by so many numbers.
SALTS = 1 << 20

PIECES = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, size_class int, salt int{more}"


def cuts(n: int, capacity: int, least_piece: int = LEAST_PIECE) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in their order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest >= least_piece:
        k = -(-capacity // rest)  # the least k with capacity // k <= rest
        out.append((capacity // k, k))
        rest -= capacity // k
    if rest:
        out.append((rest, capacity // rest))
    return out


def pieces(spark: SparkSession, docs: DataFrame, path: str, id_column: str, text_column: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece of each document: PIECES, and the ids themselves if asked for."""
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, f.read()))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "size_class", "salt", *["ids"] * with_ids]
        salt = 0
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                rows, of = [], []
                for doc, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.ids(text).astype("<u4").tobytes() + end
                    at, total = 0, len(ids) // 4
                    for length, size_class in cuts(total, capacity):
                        piece = ids[4 * at : 4 * (at + length)]
                        rows.append((at, length, zlib.crc32(piece), total, size_class, piece))
                        of.append(doc)
                        at += length
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                arrays = [part.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32())]
                arrays.append(pa.array(np.arange(salt, salt + len(of)) % SALTS, pa.int32()))
                salt = (salt + len(of)) % SALTS
                arrays += [pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in columns[5]], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names)

    picked = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, PIECES.format(kind=picked.schema["id"].dataType.simpleString(), more=", ids array<int>" * with_ids))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First fit, longest first: (bin, offset) of each piece, in the order given."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(0, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        room = np.flatnonzero(used + lengths[i] <= capacity)
        if not len(room):
            used, room = np.append(used, 0), [len(used)]
        bins[i], offsets[i] = room[0], used[room[0]]
        used[room[0]] += lengths[i]
    return bins, offsets


def harmonic_packing(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of docs with their sequence_id and their offset in it; see PIECES for the rest."""
    cut = written(spark, pieces(spark, docs, path, id_column, text_column, capacity, end_id, with_ids), "pieces")
    buckets = max(1, -(-cut.count() // BUCKET_PIECES))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32", "salt"), F.lit(buckets))).drop("salt")
    sizes = dealt.groupBy("bucket", "size_class").agg(F.count("*").alias("held"))
    in_order = Window.partitionBy("bucket", "size_class").orderBy("id", "start", "length", "ids_crc32", "doc_tokens")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({"number": F.row_number().over(in_order) - 1, "before": F.sum("length").over(so_far) - F.col("length")})
    opened = F.max(F.when(F.col("number") % F.col("size_class") == 0, F.col("before"))).over(so_far)  # lengths up to the bin's first piece
    placed = placed.withColumn("offset", F.col("before") - opened)
    numbered = placed.join(sizes, ["bucket", "size_class"]).withColumn("bin", F.floor(F.col("number") / F.col("size_class")))
    full = F.col("bin") < F.floor(F.col("held") / F.col("size_class"))
    columns = [c for c in cut.columns if c != "salt"]  # the same ones on both ways below, so that they share a shuffle
    result = [*columns, "sequence_id", "offset"]

    room = BIN_BITS + capacity.bit_length()  # classes go up to the capacity
    if buckets >= 1 << (63 - room):
        raise ValueError(f"{buckets} buckets of a capacity of {capacity} are more than sequence ids can tell apart")

    def name(size_class, bin_number):  # bucket, class and bin in one long; class 0: what was left over
        return F.shiftleft(F.col("bucket"), room) + F.shiftleft(size_class.cast("long"), BIN_BITS) + bin_number

    filled = numbered.where(full).withColumn("sequence_id", name(F.col("size_class"), F.col("bin")))
    left = numbered.where(~full).select("bucket", *columns)

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "start"], ascending=[False, True, True], kind="stable")
        group["bin"], group["offset"] = place(group["length"].to_numpy(), capacity)
        return group

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema) + ", bin long, offset long"
    rest = left.groupBy("bucket").applyInPandas(together, schema).withColumn("sequence_id", name(F.lit(0), F.col("bin")))
    return filled.select(result).unionByName(rest.select(result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = harmonic_packing(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "size_class")
