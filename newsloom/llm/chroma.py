"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

A recording (a WAV file in a binary column) becomes frames of twelve pitch classes: the energy of a
windowed transform, by the pitch class of each frequency, smoothed over time and normalised. Sixteen
filters compare areas of these frames, whose sums an integral image gives at once; each result is
quantised to two bits in Gray code, so every position in time has a packed integer of 32 bits.

Two recordings are aligned at the offset that most pairs of equal integers share (the least such offset
if several do) and match if they overlap by MIN_OVERLAP positions there and at most MAX_ERROR of the
bits differ. Recordings with equal fingerprints form a class, and classes are compared instead of
recordings: queries' classes meet all classes in a join on integers, and each pair's votes for offsets are
summed up before and after a shuffle. An integer that many classes have (silence) is split by class. Where
an integer is frequent in both recordings, its votes are a correlation by Fourier transforms instead of
pairs of positions. Sound is read and transformed a slice at a time.

Results for odd input: audio that is null, isn't PCM of 8 to 32 bits, or is too short has no integers and
is in the class of such recordings, which matches nothing; silence has one integer throughout; a file that
ends before its header says counts as far as it goes; ids may be null (a class is named by its least id) or
repeat; an empty table gives empty ones; columns that aren't named are ignored.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import sized, table, written

FRAME_S = 0.37
OVERLAPS = 3
LOWEST_HZ, HIGHEST_HZ = 55.0, 2200.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SPAN = 16  # frames that a position looks at
STEPS = np.array([-0.1, 0.0, 0.1])  # between the four values of a filter
GRAY = np.array([0, 1, 3, 2], np.uint32)
MIN_OVERLAP = 16
MAX_ERROR = 0.15
#: Windows transformed at once.
WINDOWS = 256
#: An integer of more classes than HOT is split; more than PAIRS pairs of positions are counted by transforms.
HOT, PAIRS = 5_000, 1 << 14
#: Votes in an Arrow batch, about.
VOTES = 500_000

#: (kind, lowest pitch class, pitch classes, frames); kinds: halves by pitch, halves by time, quarters crosswise, middle third by time.
FILTERS = [("pitch", p, h, w) for p, h, w in ((0, 12, 16), (0, 6, 8), (6, 6, 8), (3, 6, 4))] + [
    ("time", p, h, w) for p, h, w in ((0, 3, 16), (3, 3, 16), (6, 3, 16), (9, 3, 16), (0, 4, 6), (8, 4, 6))
] + [("cross", p, h, w) for p, h, w in ((0, 12, 16), (2, 8, 8), (0, 6, 12))] + [("middle", p, h, w) for p, h, w in ((0, 4, 15), (4, 4, 15), (8, 4, 15))]

ERRORS = T.StructType([T.StructField("overlap", T.LongType()), T.StructField("bit_errors", T.LongType())])


def samples_from(data: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples from -1 to 1."""
    data = data[: len(data) // (width * channels) * width * channels]
    if width == 1:
        found = (np.frombuffer(data, np.uint8) - 128.0) / 128
    else:  # the bytes of a sample are the upper ones of an integer of four
        wide = np.zeros((len(data) // width, 4), np.uint8)
        wide[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
        found = wide.view("<i4").ravel() / 2147483648
    return found.reshape(-1, channels).mean(axis=1)


def opened(audio: bytes | None) -> wave.Wave_read | None:
    try:
        found = wave.open(io.BytesIO(audio or b""))
    except (wave.Error, EOFError):
        return None
    return found if found.getsampwidth() in (1, 2, 3, 4) and found.getframerate() > 0 else None


def samples_of(audio: bytes | None) -> tuple[np.ndarray, int]:
    """All samples, and their rate; none for what isn't PCM."""
    f = opened(audio)
    if f is None:
        return np.zeros(0), 0
    return samples_from(f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()), f.getframerate()


@lru_cache(4)
def pitch_classes(size: int, rate: int) -> np.ndarray:
    """Which pitch class each frequency of a transform adds to, as a matrix."""
    hz = np.fft.rfftfreq(size, 1 / rate)
    heard = (hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)
    of = np.zeros((len(hz), 12))
    of[np.flatnonzero(heard), np.round(12 * np.log2(hz[heard] / 440)).astype(int) % 12] = 1
    return of


def pitch_frames(read: Callable[[int, int], np.ndarray], total: int, rate: int) -> np.ndarray:
    """Frames x 12, each of length 1, or 0 where there is silence; read gives the samples of a range."""
    size = 1 << round(np.log2(max(2.0, FRAME_S * rate)))
    hop = max(1, size // OVERLAPS)
    energy = [np.zeros((0, 12))]
    for first in range(0, max(0, (total - size) // hop + 1), WINDOWS):
        last = min(first + WINDOWS, (total - size) // hop + 1)
        samples = read(first * hop, (last - 1) * hop + size)
        if len(samples) < size:
            break
        cut = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
        energy.append(np.abs(np.fft.rfft(cut * np.hanning(size), axis=1)) ** 2 @ pitch_classes(size, rate))
    found = np.concatenate(energy)
    if len(found) < len(SMOOTH):
        return np.zeros((0, 12))
    smooth = sum(w * found[i : len(found) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    norms = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norms > 1e-6, smooth / np.maximum(norms, 1e-6), 0.0)


def packed_codes(frames: np.ndarray) -> np.ndarray:
    """The packed integer of each position in time."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        whole = area(0, w, p, p + h)
        if kind == "pitch":
            part = area(0, w, p, p + h // 2)
        elif kind == "time":
            part = area(0, w // 2, p, p + h)
        elif kind == "cross":
            part = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        else:
            part = area(w // 3, w - w // 3, p, p + h)
        value = np.log((1 + part) / (1 + whole - part))
        out = out << np.uint32(2) | GRAY[np.searchsorted(STEPS, np.round(value, 9))]
    return out


def codes_of(audio: bytes | None) -> np.ndarray:
    f = opened(audio)
    if f is None:
        return np.zeros(0, np.uint32)

    def read(first: int, last: int) -> np.ndarray:
        f.setpos(first)
        return samples_from(f.readframes(last - first), f.getsampwidth(), f.getnchannels())

    return packed_codes(pitch_frames(read, f.getnframes(), f.getframerate()))


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(overlap, differing bits) with b moved by offset: a[i + offset] against b[i]."""
    first, last = max(0, -offset), min(len(b), len(a) - offset)
    if last <= first:
        return 0, 0
    return last - first, int(np.bitwise_count(a[first + offset : last + offset] ^ b[first:last]).sum())


def with_codes(docs: DataFrame, id_column: str, audio_column: str) -> DataFrame:
    """(id, codes): the packed integers of each recording, as signed ints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 16) for i in range(0, len(batch), 16)):
                found = [codes_of(x.as_py()).view(np.int32) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "codes"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(audio_column).alias("audio")).mapInArrow(run, "id long, codes array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """(code, print, at): for each class and packed integer of it, its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = held.values.to_numpy()
                order = np.argsort(codes, kind="stable").astype(np.int32)
                distinct, begin = np.unique(codes[order], return_index=True)
                at = pa.ListArray.from_arrays(pa.array(np.append(begin, len(codes)), pa.int32()), pa.array(order))
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array([name] * len(distinct), pa.binary()), at], ["code", "print", "at"])

    return classes.where("size(codes) > 0").select("print", "codes").mapInArrow(run, "code int, print binary, at array<int>")


def votes_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which positions of a meet those of b, and how many do."""
    if len(a) * len(b) <= PAIRS:
        return np.unique(np.subtract.outer(a.astype(np.int64), b).ravel(), return_counts=True)
    x, y = np.zeros(int(a.max()) + 1), np.zeros(int(b.max()) + 1)
    x[a], y[b] = 1, 1
    size = 1 << (len(x) + len(y)).bit_length()
    found = np.rint(np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)).astype(np.int64)
    met = np.flatnonzero(found)
    return np.where(met < len(x), met, met - size), found[met]


def votes(met: DataFrame) -> DataFrame:
    """(asking, print, offset, n) of rows (asking, print, mine, theirs) with positions of one integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pairs: list, offsets: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            names = [pa.array([p[i] for p, o in zip(pairs, offsets, strict=True) for _ in range(len(o))], pa.binary()) for i in (0, 1)]
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([*names, pa.array(np.concatenate(none + offsets)), pa.array(np.concatenate(none + counts))], ["asking", "print", "offset", "n"])

        for batch in batches:
            pairs, offsets, counts, held = [], [], [], 0
            for asking, name, mine, theirs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                offset, n = votes_of(mine.values.to_numpy(), theirs.values.to_numpy())
                pairs.append((asking, name))
                offsets.append(offset)
                counts.append(n)
                held += len(offset)
                if held > VOTES:
                    yield rows(pairs, offsets, counts)
                    pairs, offsets, counts, held = [], [], [], 0
            yield rows(pairs, offsets, counts)

    return met.select("asking", "print", "mine", "theirs").mapInArrow(run, "asking binary, print binary, offset long, n long")


@F.arrow_udf(ERRORS)
def errors_of(mine: pa.Array, theirs: pa.Array, offsets: pa.Array) -> pa.Array:
    found = [bit_errors(a.values.to_numpy().view(np.uint32), b.values.to_numpy().view(np.uint32), o) for a, b, o in zip(mine, theirs, offsets.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["overlap", "bit_errors"])


def matches_of(spark: SparkSession, classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(asking, class_id, offset, overlap, bit_errors): what the classes that ask match."""
    every = written(spark, postings(classes), "postings")
    asked = written(spark, postings(classes.where("asks")).select("code", F.col("print").alias("asking"), F.col("at").alias("mine")), "asked")
    often = every.groupBy("code").agg(F.count("*").alias("held")).where(F.col("held") > hot)
    often = sized(written(spark, often.select("code", F.ceil(F.col("held") / hot).alias("parts")), "often"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    whole = every.join(often, "code", "left").select("code", "print", F.col("at").alias("theirs"), F.pmod(F.xxhash64("print"), parts).alias("part"))
    split = asked.join(often, "code", "left").select("code", "asking", "mine", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    met = split.join(whole, ["code", "part"]).where(F.col("asking") != F.col("print"))
    summed = votes(met).groupBy("asking", "print", "offset").agg(F.sum("n").alias("n"))
    best = summed.groupBy("asking", "print").agg(F.max(F.struct("n", (-F.col("offset")).alias("less"))).alias("best"))
    pairs = written(spark, best.select("asking", "print", (-F.col("best.less")).alias("offset")), "pairs")
    mine = classes.select(F.col("print").alias("asking"), F.col("class_id").alias("asking_id"), F.col("codes").alias("mine"))
    theirs = classes.select("print", "class_id", F.col("codes").alias("theirs"))
    judged = pairs.join(mine, "asking").join(theirs, "print").withColumn("found", errors_of("mine", "theirs", "offset"))
    near = (F.col("found.overlap") >= MIN_OVERLAP) & (F.col("found.bit_errors") <= MAX_ERROR * 32 * F.col("found.overlap"))
    return judged.where(near).select(F.col("asking_id").alias("asking"), "class_id", "offset", "found.overlap", "found.bit_errors")


def aligned_recordings(spark: SparkSession, docs: DataFrame, is_query: Column, id_column: str = "id", audio_column: str = "audio", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Each recording's class (id, class_id, codes), and what the classes of queries match among the others.

    is_query: a condition on id. Matches: asking and class_id, both names of classes, the offset of the
    latter in the former, overlap and bit_errors.
    """
    rows = written(spark, with_codes(docs, id_column, audio_column), "codes")
    print_of = F.unhex(F.sha2(F.array_join("codes", ","), 256))
    asks = F.max(F.coalesce(is_query, F.lit(False))).alias("asks")
    classes = written(spark, rows.groupBy(print_of.alias("print")).agg(F.min("id").alias("class_id"), asks, F.first("codes").alias("codes")), "classes")
    members = rows.withColumn("print", print_of).join(classes.select("print", "class_id"), "print").select("id", "class_id", "codes")
    return members, matches_of(spark, classes, hot)


def tone_sequence(values: list[float] | None, rate: int = 5512, note_s: float = 0.1) -> bytes | None:
    """A WAV file with a note for each number: what stands for recordings in tables that have none."""
    if values is None:
        return None
    numbers = np.nan_to_num(np.array([0.0 if v is None else v for v in values]))
    hz = 440 * 2 ** (np.clip(np.round(numbers * 48), -24, 24) / 12)
    within = np.arange(int(rate * note_s))
    sound = 0.6 * np.sin(2 * np.pi * hz[:, None] / rate * within) * np.hanning(len(within))
    file = io.BytesIO()
    with wave.open(file, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((sound * 32767).astype("<i2").tobytes())
    return file.getvalue()


@F.arrow_udf(T.LongType())
def codes_crc32(codes: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(np.array(c, "<i4").tobytes()) for c in codes.to_pylist()], pa.int64())


def played(vectors: DataFrame) -> DataFrame:
    """(id, audio) of (id, embedding), in batches of few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tone_sequence(v) for v in part.column(1).to_pylist()], pa.binary())], ["id", "audio"])

    return vectors.mapInArrow(run, "id long, audio binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings played as notes: a row per recording with its class, and a row per match of a class that has an id divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    members, matches = aligned_recordings(spark, played(vectors), F.col("id") % 50 == 0)
    rows = members.select(F.col("id").alias("vec_id"), "class_id", F.size("codes").cast("long").alias("n_codes"), codes_crc32("codes").alias("codes_crc32"))
    pairs = matches.select(F.col("asking").alias("class_id"), F.col("class_id").alias("match_class_id"), "offset", "overlap", "bit_errors")
    return rows.unionByName(pairs, allowMissingColumns=True)
