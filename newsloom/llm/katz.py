"""Katz backoff language model, learned from the corpus and applied to it.

The model. Tokens are words in lower case and one end per text. For an n-gram seen c times in the
training texts after a context seen C times, p* = d(c) c / C, where d is the Good-Turing discount of
its order. A token whose n-gram wasn't seen gets the probability of the next shorter n-gram times the
backoff weight of the context, alpha = (1 - sum of p*) / (1 - sum of the shorter p*) over all tokens
seen after it; a context that wasn't seen has weight 1. Below single tokens stands one unknown token,
which gets what discounting took from all of them. So the probabilities after each context add up to
1 over the training tokens and the unknown one. The context is what the text has before the token, up
to order - 1 tokens.

Discounts: up to CUTOFF by Katz's formula from the counts of counts n_1 .. n_(CUTOFF+1); where these are
not in order (0 < d_1 <= .. <= d_CUTOFF < 1), by a line through their logarithms. A larger count loses
the same amount as a count of CUTOFF does, so each context keeps something for unseen tokens.

How it runs. Texts become batches of about a million tokens, a written table. Every batch sends its
distinct n-grams of each order, 64-bit hashes with their training counts, to the shards of that order;
an n-gram comes from a batch once, however frequent it is, and shards divide the range of the hash
evenly. A shard adds up and answers each batch in the order of its question, in a table partitioned by
order; one batch is told to own an n-gram, and a batch is told which n-grams no other batch has. Batches
then know all counts they need for p*. A context that one batch alone holds is weighed there. For the
others, the owners send what each context's shard needs for the two sums; the shard keeps the weights in
a table partitioned by order and adds the logarithms that documents asked for. Tables and shuffles that
nothing needs any more are removed as it goes.

Growth. What is shuffled is a few bytes for each distinct n-gram of a batch. A row is a batch's n-grams of
one shard: there are 2^LEAST_BITS shards at least, so rows grow with the batches until the corpus has
2^LEAST_BITS x SHARD_TOKENS tokens; beyond that the shards grow as well and rows hold fewer n-grams, down
to one. A shard holds about SHARD_TOKENS n-grams and, of a word that is everywhere, one entry a batch.

Hashes are 64 bits wide: among M n-grams an unseen one is taken for a seen one with probability
M / 2^64.

Results for odd input: a null text is an empty one, whose only token is the end; a very long text is in
one batch; the discounts don't depend on the order of rows, so ties have no say; rows with a null id
are held out and scored; repeated rows are scored each, and learned from each; with nothing to learn
from every score is 0; columns that aren't named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from newsloom.llm.common import is_held_out, new_path, removed, table, written
from newsloom.llm.tokens import slices

ORDER = 3
CUTOFF = 5
BATCH_BYTES = 8_000_000
SHARD_TOKENS = 4_000_000
LEAST_BITS = 9
#: Low bits of a float that are left out where it is sent: the rest is exact to 2^-37.
CUT_BITS = np.uint64(0xFFFF)
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word has a space

BATCH = "batch long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary"
ASKED = "order int, shard int, batch long, keys binary, counts binary"
ANSWERED = "shard int, batch long, answers binary, order int"
FOUND = """batch long, place int, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double,
    order int, shard int, keys binary, totals binary, few binary, lower binary, wanted binary, docs binary"""
WEIGHED = "shard int, batch long, places binary, log_weights binary, keys binary, weights binary, order int"
SUMMED = "batch long, place int, log_weight double"


def packed(values: np.ndarray) -> bytes:
    """Integers or floats, compressed; a first byte tells the type."""
    if values.dtype.kind in "iu" and len(values):
        values = values.astype(np.min_scalar_type(int(values.max())))
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.copy()
    return values.dtype.str[1:].encode() + zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:2].decode())
    planes = np.frombuffer(zstandard.decompress(data[2:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rounded(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) & ~CUT_BITS).view(np.float64)


def packed_keys(keys: np.ndarray) -> bytes:
    """64-bit keys by their differences, which are small where they ascend."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes, the most frequent first and equals ascending, the tokens as places among them, tokens per text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    starts, flat = words.offsets.to_numpy().astype(np.int64), words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py())
    starts -= starts[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    before = np.concatenate(([0], np.cumsum(real)))
    lengths = np.diff(before[starts]) + 1
    tokens = np.full(int(lengths.sum()), END)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = hashes[coded.indices.to_numpy()][real] if len(flat) else tokens[inner]
    distinct, places, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -counts))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[places], lengths


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the key of its first n - 1 tokens and its last token's."""
    x = (context ^ (context >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order: the keys of the n-grams, and the position of each one's last token."""
    within = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys, at = [tokens], [np.arange(len(tokens))]
    full = tokens
    for k in range(2, order + 1):
        full = np.concatenate((tokens[:1], joined(full[:-1], tokens[1:])))
        at.append(np.flatnonzero(within >= k - 1))
        keys.append(full[at[-1]])
    return keys, at


def shard_edges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of ascending keys with the same leading bits."""
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(shards, prepend=-1))
    for b, e in zip(begin.tolist(), np.append(begin, len(keys))[1:].tolist(), strict=False):
        yield int(shards[b]), slice(b, e)


def rows_to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.replace("\n", " ").replace("    ", "").split(", ")), strict=True)
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def batches_of(docs: DataFrame) -> DataFrame:
    """docs (id, text, held) as BATCH rows."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in arrived:
            for part in slices(batch, BATCH_BYTES):
                words, tokens, lengths = tokenised(part.column(1))
                yield rows_to_batch([(number, part.column(0).to_pylist(), part.column(2).to_pylist(), lengths.tolist(), packed(tokens), packed_keys(words))], BATCH)
                number += 1

    return docs.mapInArrow(run, BATCH)


def questions(batches: DataFrame, order: int, bits: int) -> DataFrame:
    """Each batch's distinct n-grams of that order with their training counts, by shard: ASKED."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in arrived:
            for row in some.to_pylist():
                lengths = np.array(row["lengths"])
                tokens = unpacked_keys(row["words"])[unpacked(row["tokens"])]
                learned = np.repeat(~np.array(row["held"]), lengths)
                keys, at = (x[-1] for x in ngrams(tokens, lengths, order))
                distinct, places = np.unique(keys, return_inverse=True)
                counts = np.bincount(places[learned[at]], minlength=len(distinct))
                yield rows_to_batch([(order, s, row["batch"], packed_keys(distinct[x]), packed(counts[x])) for s, x in shard_edges(distinct, bits)], ASKED)

    return batches.mapInArrow(run, ASKED)


def answer(group: pa.Table) -> pa.Table:
    """All questions to a shard: four times the count, plus 2 for the batch that owns the n-gram, plus 1 if no other batch has it.

    A row for no batch (-1) holds n_1 .. n_(CUTOFF+1), the number of n-grams and the sum of their counts.
    """
    rows = sorted(group.to_pylist(), key=lambda r: r["batch"])
    keys, counts = [unpacked_keys(r["keys"]) for r in rows], np.concatenate([unpacked(r["counts"]) for r in rows]).astype(np.int64)
    distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(places, weights=counts, minlength=len(distinct)).astype(np.int64)
    learned = np.flatnonzero(counts)
    answers = 4 * sums[places] + (np.bincount(places)[places] == 1)
    answers[learned[np.unique(places[learned], return_index=True)[1]]] += 2
    order, shard, out, begin = rows[0]["order"], rows[0]["shard"], [], 0
    for r, k in zip(rows, keys, strict=True):
        out.append((shard, r["batch"], packed(answers[begin : begin + len(k)]), order))
        begin += len(k)
    few = np.bincount(sums[sums <= CUTOFF + 1], minlength=CUTOFF + 2)[1:]
    out.append((shard, -1, packed(np.array([*few, (sums > 0).sum(), sums.sum()])), order))
    return pa.Table.from_batches([rows_to_batch(out, ANSWERED)])


class Discounts:
    """Good-Turing discounts of one order, from its counts of counts."""

    def __init__(self, few: list[int], kinds: int, total: int):
        self.few, self.kinds, self.total = few, kinds, total
        n = np.array([0, *few], float)
        r = np.arange(1, CUTOFF + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
            d = ((r + 1) * n[2:] / (r * n[1:-1]) - least) / (1 - least)
        if not (np.isfinite(d).all() and d[0] > 0 and d[-1] < 1 and (np.diff(d) >= 0).all()):
            x = np.flatnonzero(n[1:]) + 1
            slope = np.polyfit(np.log(x), np.log(n[x]), 1)[0] if len(x) > 1 else -2.0
            d = (1 + 1 / r) ** (min(slope, -1.2) + 1)  # (r + 1) n_(r+1) / (r n_r) on that line
        self.small, self.taken = np.concatenate(([1.0], d)), CUTOFF * (1 - d[-1])

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(counts <= CUTOFF, counts * self.small[np.minimum(counts, CUTOFF)], counts - self.taken)

    def lost(self, few: np.ndarray) -> np.ndarray:
        """What n-grams lose, few: how many of them have the counts 1 .. CUTOFF and more."""
        return few @ np.append(np.arange(1, CUTOFF + 1) * (1 - self.small[1:]), self.taken)

    def unknown(self) -> float:
        """The share of what discounting has taken from all n-grams of this order."""
        r = np.arange(1, CUTOFF + 1)
        few = np.array(self.few[:CUTOFF])
        return float((few * r * (1 - self.small[1:])).sum() + (self.kinds - few.sum()) * self.taken) / self.total


def few_of(counts: np.ndarray, share: np.ndarray, contexts: int) -> np.ndarray:
    """For each context how many of its n-grams have the counts 1 .. CUTOFF and more."""
    size = np.minimum(counts, CUTOFF + 1) - 1
    return np.bincount(share * (CUTOFF + 1) + size, minlength=contexts * (CUTOFF + 1)).reshape(contexts, CUTOFF + 1)


def weights_of(totals: np.ndarray, few: np.ndarray, lower: np.ndarray, discounts: Discounts) -> np.ndarray:
    return discounts.lost(few) / totals / (1 - lower)


def scored(batch: dict, answers: list[np.ndarray], discounts: list[Discounts], bits: int) -> list[tuple]:
    """FOUND rows of a batch: its documents' sums of logarithms, and what it has for each context shard."""
    order, lengths = len(discounts), np.array(batch["lengths"])
    tokens = unpacked_keys(batch["words"])[unpacked(batch["tokens"])]
    keys, at = ngrams(tokens, lengths, order)
    docs = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    total, kinds = discounts[0].total, discounts[0].kinds
    size = len(tokens)
    key_at = np.zeros((order, size), np.uint64)
    count_at = np.zeros((order, size), np.int64)
    alone_at = np.zeros((order, size), bool)
    p_at = np.zeros((order, size))
    owned = []  # for each order the last positions of the n-grams that this batch owns, each once
    for k in range(order):
        distinct, first, places = np.unique(keys[k], return_index=True, return_inverse=True)
        key_at[k, at[k]] = keys[k]
        count_at[k, at[k]] = (answers[k] >> 2)[places]
        alone_at[k, at[k]] = (answers[k] & 1).astype(bool)[places]
        owned.append(at[k][first[(answers[k] & 2).astype(bool)]])
        seen = np.flatnonzero(count_at[k])
        context = count_at[k - 1, seen - 1] if k else total
        p_at[k, seen] = discounts[k].kept(count_at[k, seen]) / context
    logs = np.full(size, math.log10(discounts[0].unknown()) if total else 0.0)
    asked = [np.ones(size, bool)]  # whether the context of each order weighs in at a position
    longest = np.zeros(size, np.int64)
    for k in range(order):
        seen = count_at[k] > 0
        logs[seen] = np.log10(p_at[k, seen])
        longest[seen] = k + 1
        if k:
            known_context = np.zeros(size, bool)
            known_context[at[k]] = count_at[k - 1, at[k] - 1] > 0
            asked.append(known_context)
    rows = []
    for k in range(1, order):
        mine = owned[k]
        context, first, share = np.unique(key_at[k - 1, mine - 1], return_index=True, return_inverse=True)
        totals, few = count_at[k - 1, mine[first] - 1], few_of(count_at[k, mine], share, len(context))
        lower = np.bincount(share, p_at[k - 1, mine], len(context))
        need = np.flatnonzero(asked[k] & (longest < k + 1))
        need = need[np.argsort(key_at[k - 1, need - 1], kind="stable")]
        here = alone_at[k - 1, mine[first] - 1]
        at_home = alone_at[k - 1, need - 1]
        own_logs = np.log10(weights_of(totals[here], few[here], lower[here], discounts[k]))
        logs[need[at_home]] += own_logs[np.searchsorted(context[here], key_at[k - 1, need[at_home] - 1])]
        context, totals, few, lower, need = context[~here], totals[~here], few[~here], rounded(lower[~here]), need[~at_home]
        wanted, wanting = key_at[k - 1, need - 1], docs[need]
        given, taken_by = dict(shard_edges(context, bits)), dict(shard_edges(wanted, bits))
        none = slice(0, 0)
        for shard in sorted({*given, *taken_by}):
            x, y = given.get(shard, none), taken_by.get(shard, none)
            sent = (packed_keys(context[x]), packed(totals[x]), packed(few[x].T.ravel()), packed(lower[x]), packed_keys(wanted[y]), packed(wanting[y]))
            rows.append((batch["batch"], *[None] * 7, k, shard, *sent))
    base = np.log10((count_at[0] + 1.0) / (total + kinds + 1.0))
    columns = [np.add.reduceat(x, begin) for x in ((count_at[0] > 0).astype(np.int64), base, logs)]
    for i, (doc, held, n) in enumerate(zip(batch["ids"], batch["held"], lengths.tolist(), strict=True)):
        rows.append((batch["batch"], i, doc, held, n, int(columns[0][i]), float(columns[1][i]), float(columns[2][i]), *[None] * 8))
    return rows


def weigh(group: pa.Table, discounts: list[Discounts]) -> pa.Table:
    """The backoff weights of a shard's contexts, and for each batch the sums of their logarithms by document, packed."""
    rows = group.to_pylist()
    order, shard = rows[0]["order"], rows[0]["shard"]
    keys = np.concatenate([unpacked_keys(r["keys"]) for r in rows])
    distinct, first, places = np.unique(keys, return_index=True, return_inverse=True)
    totals = np.concatenate([unpacked(r["totals"]) for r in rows])[first].astype(np.int64)
    few_at = np.concatenate([unpacked(r["few"]).reshape(CUTOFF + 1, -1).T for r in rows])
    few = np.stack([np.bincount(places, few_at[:, r], len(distinct)) for r in range(CUTOFF + 1)], axis=1)
    lower = np.bincount(places, np.concatenate([unpacked(r["lower"]) for r in rows]), len(distinct))
    weights = weights_of(totals, few, lower, discounts[order])
    out: list[tuple] = [(shard, -1, None, None, packed_keys(distinct), packed(rounded(weights)), order)]
    logs = np.log10(weights)
    for r in rows:
        wanted = unpacked_keys(r["wanted"])
        if len(wanted):
            docs, which = np.unique(unpacked(r["docs"]), return_inverse=True)
            sums = np.bincount(which, logs[np.searchsorted(distinct, wanted)], len(docs))
            out.append((shard, r["batch"], packed(docs), packed(sums), None, None, order))
    return pa.Table.from_batches([rows_to_batch(out, WEIGHED)])


def summed(group: pa.Table) -> pa.Table:
    """What all shards reply to a batch, added up by document."""
    rows = group.to_pylist()
    places = np.concatenate([unpacked(r["places"]).astype(np.int64) for r in rows])
    distinct, which = np.unique(places, return_inverse=True)
    sums = np.bincount(which, np.concatenate([unpacked(r["log_weights"]) for r in rows]), len(distinct))
    return pa.table({"batch": pa.array([rows[0]["batch"]] * len(distinct), pa.int64()), "place": pa.array(distinct, pa.int32()), "log_weight": pa.array(sums, pa.float64())})


def statistics(answered: DataFrame, order: int) -> list[list[int]]:
    """For each order n_1 .. n_(CUTOFF+1), the number of n-grams and the sum of their counts, added up over the shards."""
    names = [f"s{i}" for i in range(CUTOFF + 3)]

    def read(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in arrived:
            found = np.array([unpacked(x).astype(np.int64) for x in some.column(1).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, found.T)], ["order", *names])

    own = answered.where("batch = -1").select("order", "answers").mapInArrow(read, "order int, " + ", ".join(f"{n} long" for n in names))
    rows = {r.order: [r[n] for n in names] for r in own.groupBy("order").agg(*[F.sum(n).alias(n) for n in names]).collect()}
    return [rows.get(k, [0] * len(names)) for k in range(1, order + 1)]


def katz_scores(spark: SparkSession, docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of each row of docs by the model of the rows that aren't held out.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), held_out.alias("held"))
    paths = [new_path(spark, name) for name in ("batches", "counts")]
    batches = written(spark, batches_of(picked), "batches", paths[0])
    size = batches.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, size / SHARD_TOKENS))))
    for k in range(1, order + 1):  # one after the other, so that the questions of one order are on disk at a time
        written(spark, questions(batches, k, bits).groupBy("shard").applyInArrow(answer, ANSWERED).drop("order"), "counts", f"{paths[1]}/order={k}")
    answered = spark.read.schema(ANSWERED).parquet(paths[1])
    sums = statistics(answered, order)
    discounts = [Discounts(s[: CUTOFF + 1], s[-2], s[-1]) for s in sums]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        (batch,) = left.to_pylist()
        got = sorted(right.to_pylist(), key=lambda r: (r["order"], r["shard"]))
        answers = [np.concatenate([np.zeros(0, np.int64), *(unpacked(r["answers"]).astype(np.int64) for r in got if r["order"] == k)]) for k in range(1, order + 1)]
        return pa.Table.from_batches([rows_to_batch(scored(batch, answers, discounts, bits), FOUND)])

    def weighed_by(group: pa.Table) -> pa.Table:
        return weigh(group, discounts)

    replies = answered.where("batch >= 0").select("shard", "batch", "answers", "order")
    found = written(spark, batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(score, FOUND), "scored")
    removed(spark, *paths)
    contexts = found.where("order IS NOT NULL").select("order", "shard", "batch", "keys", "totals", "few", "lower", "wanted", "docs")
    weighed = written(spark, contexts.groupBy("order", "shard").applyInArrow(weighed_by, WEIGHED), "weights", by=("order",))
    backed_off = weighed.where("batch >= 0").groupBy("batch").applyInArrow(summed, SUMMED)
    rows = found.where("order IS NULL").join(backed_off, ["batch", "place"], "left")
    return rows.select(
        "id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(discounts[0].total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("score") + F.coalesce("log_weight", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark, table(spark, sf_dir, "documents"), is_held_out("doc_id", 7)).withColumnRenamed("id", "doc_id")
