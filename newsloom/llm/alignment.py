"""Two tokenizers' tokens of a text aligned by their bytes.

Tokenizer A is a byte-level vocabulary, B one of sentencepiece, which puts a space before a text; A gets that space as
well, so that both cut the same bytes. The ends of a slice's tokens are marked in packed bitsets, one for each tokenizer. Their
AND are the cuts that both have; the rank of a cut in a bitset (a running sum of popcounts by word, plus the
popcount within the word) tells how many tokens end there or before, so that two following cuts give a group's ranges of
tokens. Every A-B pair of occurrences within a group is a link.

The count of an id pair is the number of documents that hold it linked. Documents keep their distinct pairs with the
number of links of each, a written table. Batches of it add up to counts of pairs: what is shuffled is a row for each distinct pair of
a task. The FREQUENT commonest pairs are sent to all tasks as two arrays, which is a bounded size; documents
look most of their links up there. Only the rest are shuffled: pairs that are rarer than any of those sent, so that
no pair holds more than a FREQUENT-th part of all rows. The highest count of each A id is a row of a vocabulary.

A text is encoded in parts: where a single space stands between two other characters, neither tokenizer has a token
across the place before it. For A its pattern says so; B has no piece with a space after another character, and
`cuts_at_spaces` proves that of a vocabulary; without it texts are encoded whole.

Results for odd input: null and empty texts, and texts whose tokens don't spell them (U+2581 is spelled as a space by B), have
no tokens and zeros; very long texts are encoded in parts, and a document of very many pairs gives its pairs in several
rows; ties for an A id's highest count all count as best; repeated rows are documents each; rows with a null id are kept; an
empty table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import new_path, scratch, table, written
from newsloom.llm.tokens import VOCABULARY, ranks, slices

PIECES = "piece_bpe_32k.model"
#: Texts are handled in slices of about so many bytes, and encoded in parts of so many characters.
SLICE_BYTES, PART_CHARS = 2_000_000, 100_000
#: A single space between two characters that aren't white space for anybody.
CUT = regex.compile(r"(?<=[^\pZ\pC]) (?=[^\pZ\pC])")
#: Pairs whose counts are sent to all tasks, links that are expanded at once, pairs of a row.
FREQUENT, LINKS, ROW_PAIRS = 1_000_000, 500_000, 250_000
SPACE = "▁"
_ready: dict[str, "Tokenizers"] = {}


class Tokenizers:
    """Both tokenizers in a worker, the bytes and lengths of their tokens, and how ids are written."""

    def __init__(self, definition: bytes, model: bytes):
        of_bytes = ranks(definition)
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of_bytes, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spelled_a = [b""] * (max(of_bytes.values()) + 1)
        for token, i in of_bytes.items():
            self.spelled_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in s], np.int64) for s in (self.spelled_a, self.spelled_b))
        self.in_parts = cuts_at_spaces(pieces)
        # an id as it stands within a group, at the end of its tokenizer's ids, and (B) at the end of a document
        names_a, names_b = ([str(i) for i in range(len(s))] for s in (self.spelled_a, self.spelled_b))
        self.written = np.array([n + e for names, ends in ((names_a, ",|"), (names_b, ",;")) for e in ends for n in names] + names_b, object)
        self.size = len(names_a)  # a pair is a * 2^32 + b

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by both, or None if they don't spell it."""
        a, b = [], []
        for part in parts_of(text) if self.in_parts else [text]:
            said = " " + part
            ids_a, ids_b = self.a.encode_ordinary(said), self.b.encode(part)
            whole = said.encode()
            if b"".join(map(self.spelled_a.__getitem__, ids_a)) != whole or b"".join(map(self.spelled_b.__getitem__, ids_b)) != whole:
                return None
            a.append(np.array(ids_a, np.int64))
            b.append(np.array(ids_b, np.int64))
        return np.concatenate(a), np.concatenate(b)


def cuts_at_spaces(pieces: list[str]) -> bool:
    """Whether no piece has a space after another character."""
    return all(SPACE not in p.lstrip(SPACE) for p in pieces)


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text without the spaces at which it is cut."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


# --- bitsets --------------------------------------------------------------------------------------------------


class Bits:
    """A packed bitset of token ends with rank."""

    def __init__(self, ends: np.ndarray, size: int):
        marks = np.zeros((size // 64 + 1) * 64, np.uint8)
        marks[ends - 1] = 1
        self.words = np.packbits(marks, bitorder="little").view(np.uint64)

    def ranked(self) -> Bits:
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        return self

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """How many tokens end at each of these places or before."""
        word, bit = (ends - 1) >> 6, (ends - 1) & 63
        within = self.words[word] & (np.uint64(0xFFFF_FFFF_FFFF_FFFF) >> (63 - bit).astype(np.uint64))
        return self.before[word] + np.bitwise_count(within)


def selected(words: np.ndarray) -> np.ndarray:
    """The ends that are marked."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + 1


class Groups(NamedTuple):
    """Ranges of tokens by group: begins and ends in A and in B."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray
    cuts: np.ndarray


def groups_of(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Groups:
    """Groups of tokens of these lengths that spell the same bytes."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    size = int(ends_a[-1]) if len(ends_a) else 0
    a, b = Bits(ends_a, size).ranked(), Bits(ends_b, size).ranked()
    cuts = selected(a.words & b.words)
    ranks_a, ranks_b = a.rank(cuts), b.rank(cuts)
    return Groups(np.r_[0, ranks_a[:-1]], ranks_a, np.r_[0, ranks_b[:-1]], ranks_b, cuts) if len(cuts) else Groups(*[np.zeros(0, np.int64)] * 5)


def ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of these ranges, one after the other."""
    n = ends - begins
    return np.repeat(begins - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else n


def links(a: np.ndarray, b: np.ndarray, g: Groups, most: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one document's groups, and the number of links of each; at most about `most` links at once."""
    each = (g.a_end - g.a) * (g.b_end - g.b)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(pairs: np.ndarray, n: np.ndarray) -> None:
        held.append((pairs, n))
        if len(held) > 8:
            held[:] = [summed(held)]

    small = each <= most
    for run in np.split(np.flatnonzero(small), np.flatnonzero(np.diff(np.cumsum(each[small]) // most)) + 1):
        if len(run):
            wide = (g.b_end - g.b)[run]
            of_a = ranges(g.a[run], g.a_end[run])
            times = np.repeat(wide, (g.a_end - g.a)[run])
            begin_b = np.repeat(g.b[run], (g.a_end - g.a)[run])
            keep(*np.unique((np.repeat(a[of_a], times) << 32) + b[ranges(begin_b, begin_b + times)], return_counts=True))
    for k in np.flatnonzero(~small):  # a group of very many tokens without a common cut: its distinct ids
        ids_a, n_a = np.unique(a[g.a[k] : g.a_end[k]], return_counts=True)
        ids_b, n_b = np.unique(b[g.b[k] : g.b_end[k]], return_counts=True)
        step = max(1, most // len(ids_b))
        for at in range(0, len(ids_a), step):
            keep(((ids_a[at : at + step, None] << 32) + ids_b[None, :]).ravel(), (n_a[at : at + step, None] * n_b[None, :]).ravel())
    return summed(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


def written_groups(t: Tokenizers, a: np.ndarray, b: np.ndarray, g: Groups) -> str:
    """The digest of a1,a2|b1;a3|b2,b3 for one document's groups."""
    n_a, n_b, rows_b = t.size, len(t.spelled_b), 2 * t.size
    codes_a, codes_b = a.copy(), b + rows_b
    codes_a[g.a_end - 1] += n_a
    codes_b[g.b_end - 1] += n_b
    codes_b[-1] += n_b  # no semicolon after the last
    codes = np.empty(len(a) + len(b), np.int64)
    of_a, of_b = np.arange(len(g.a)).repeat(g.a_end - g.a), np.arange(len(g.b)).repeat(g.b_end - g.b)
    codes[np.arange(len(a)) + g.b[of_a]] = codes_a
    codes[np.arange(len(b)) + g.a_end[of_b]] = codes_b
    digest = hashlib.sha256()
    for at in range(0, len(codes), 1_000_000):
        digest.update("".join(t.written[codes[at : at + 1_000_000]].tolist()).encode())
    return digest.hexdigest()


# --- the operator ---------------------------------------------------------------------------------------------

ALIGNED = "row long, part int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def aligned(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """ALIGNED: each document's figures with its first pairs, and further rows of pairs if it has very many."""
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, *(open(p, "rb").read() for p in (path_a, path_b))))
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.col(id_column).alias("id"))
    names = ["row", "part", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, definition, model = sent.value
        if token not in _ready:
            _ready.clear()
            _ready[token] = Tokenizers(definition, model)
        t = _ready[token]
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield from rows_of(t, part)

    def rows_of(t: Tokenizers, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids = [(t.encoded(text) if text else None) or none for text in part.column(1).to_pylist()]
        a, b = np.concatenate([x[0] for x in ids] or [none[0]]), np.concatenate([x[1] for x in ids] or [none[0]])
        g = groups_of(t.lengths_a[a], t.lengths_b[b])
        at_a, at_b = np.cumsum([0, *(len(x[0]) for x in ids)]), np.cumsum([0, *(len(x[1]) for x in ids)])
        at_g = np.searchsorted(g.a, at_a)  # a document's end is an end of both
        out: list[tuple] = []
        size = 0
        for k, (mine_a, mine_b) in enumerate(ids):
            of = slice(at_g[k], at_g[k + 1])
            own = Groups(g.a[of] - at_a[k], g.a_end[of] - at_a[k], g.b[of] - at_b[k], g.b_end[of] - at_b[k], g.cuts[of])
            pairs, n = links(mine_a, mine_b, own)
            sha = written_groups(t, mine_a, mine_b, own) if len(mine_a) else ""
            for number, first in enumerate(range(0, max(1, len(pairs)), ROW_PAIRS)):
                held = slice(first, first + ROW_PAIRS)
                figures = (len(mine_a), len(mine_b), len(own.a), int(n.sum()), sha) if number == 0 else (None,) * 5
                out.append((k, number, *figures, pairs[held], n[held]))
                size += len(pairs[held])
                if size > ROW_PAIRS:
                    yield batch_of(part, out)
                    out, size = [], 0
        if out:
            yield batch_of(part, out)

    def batch_of(part: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        k, number, *figures, pairs, n = zip(*out, strict=True)
        offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, n)]
        kinds = [pa.int64()] * 4 + [pa.string()]
        at = pa.array(k, pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(number, pa.int32()), part.column(2).take(at), *(pa.array(f, kind) for f, kind in zip(figures, kinds, strict=True)), *lists], names)

    return picked.mapInArrow(run, ALIGNED.format(kind=picked.schema["id"].dataType.simpleString()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many documents of ALIGNED rows each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            pairs = batch.column(0).flatten().to_numpy()
            for at in range(0, len(pairs), LINKS):
                held.append(np.unique(pairs[at : at + LINKS], return_counts=True))
                size += len(held[-1][0])
                if size > 2 * LINKS:
                    held = [summed(held)]
                    size = len(held[0][0])
                if size > LINKS:
                    yield from given(held)
                    held, size = [], 0
        yield from given(held)

    def given(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            pairs, n = summed(held)
            for at in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> int:
    """The least count of which at most `most` pairs have it or more, up to an eighth of an octave."""
    bins = counts.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    total, least = 0, 1 << 62
    for b in bins:  # a few hundred
        total += b.pairs
        if total > most:
            break
        least = b.least
    return least


def alignment(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", most_frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row of docs."""
    rows = written(spark, aligned(spark, docs, path_a, path_b, id_column, text_column), "aligned")
    counts = written(spark, pair_counts(rows), "pair-counts")
    token_a = F.shiftright("pair", 32)
    tops = counts.groupBy(token_a.alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most a row for each id of A
    best = np.zeros(1 << 20, np.int64) if not len(tops) else np.zeros(int(tops["a"].to_numpy().max()) + 1, np.int64)
    best[tops["a"].to_numpy()] = tops["n"].to_numpy()
    least = frequent(counts, most_frequent)
    sent_pairs = counts.where(F.col("n") >= least).toArrow()  # at most most_frequent rows
    order = np.argsort(sent_pairs["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((sent_pairs["pair"].to_numpy()[order], sent_pairs["n"].to_numpy()[order], best))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums for each row of pairs, and a row for each pair that isn't frequent."""
        known, n_known, best = sent.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                pairs, n = (part.column(i).flatten().to_numpy() for i in (1, 2))
                of = np.repeat(np.arange(len(part)), np.diff(part.column(1).offsets.to_numpy()))
                place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                count = np.where(hit, n_known[place] if len(known) else 0, 0)
                top = hit & (count == best[pairs >> 32])
                edges = np.r_[0, np.cumsum(np.diff(part.column(1).offsets.to_numpy()))]
                sums = [np.diff(np.r_[0, np.cumsum(x)][edges]) for x in (np.where(top, n, 0), n * count)]
                row = part.column(0).to_numpy()
                rare = ~hit
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row), none, none, pa.array(sums[0]), pa.array(sums[1])], ["row", "pair", "links", "n_best", "count_sum"])
                nothing = pa.nulls(int(rare.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row[of[rare]]), pa.array(pairs[rare]), pa.array(n[rare]), nothing, nothing], ["row", "pair", "links", "n_best", "count_sum"])

    looked = written(spark, rows.select("row", "pairs", "links").mapInArrow(looked_up, "row long, pair long, links long, n_best long, count_sum long"), "looked-up")
    rare = looked.where("pair IS NOT NULL").select("row", "pair", "links").join(counts.where(F.col("n") < least).hint("shuffle_hash"), "pair")
    tops_by_a = F.broadcast(spark.createDataFrame(tops.rename_columns(["a", "top"]) if len(tops) else [], "a long, top long"))
    weighed = rare.withColumn("a", token_a).join(tops_by_a, "a").select("row", F.when(F.col("n") == F.col("top"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    sums = looked.where("pair IS NULL").select("row", "n_best", "count_sum").unionByName(weighed).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = rows.where("part = 0").select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return figures.join(sums, "row").drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        found = alignment(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))
        kept = written(spark, found, "alignment", new_path(spark, "alignment"))
    return kept.withColumnRenamed("id", "doc_id")
