"""Token counts and ids with the library of a public tokenizer, most of it by lookup.

A byte-level tokenizer cuts a text into pre-tokens before it merges. A single space between two
characters that aren't white space always begins a pre-token, so a text may be cut there into chunks
whose tokens don't depend on their surroundings. Texts with other white space around a space, or with
the string of an added token, are a chunk as a whole. Chunks repeat a lot: each distinct chunk of a
slice of texts is looked up once.

Counting uses the whole-token shortcut: `whole_tokens` proves offline, by the library itself, which
vocabulary strings encode alone as one token; a pre-token among them counts 1 without any merging and
only the rest is merged. Chunks of characters that all versions of Unicode class alike are cut into pre-tokens with
the pattern of the vocabulary; any other chunk is encoded as it is.

The tokenizer's file is read on the driver and sent to the tasks: a vocabulary doesn't grow with the
data. Results for odd input: a null text counts as empty and has no tokens; rows with null ids and
repeated rows are kept as they are; columns that aren't named are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
#: Texts are handled in slices of about so many bytes, which bounds the memory of a task.
SLICE_BYTES = 12_000_000
SPACES = r"\pZ\x09-\x0D\x1C-\x1F\x{85}"
#: White space beside a space, or at an end: such a text isn't cut.
UNCUT = f"^[{SPACES}]|[{SPACES}]$| [{SPACES}]|[{SPACES}] "
#: Characters whose kind (letter, digit, other) is the same in every version of Unicode that a library may have:
#: Latin, Greek, Cyrillic, Arabic, kana, CJK, Hangul, full-width forms.
SETTLED = regex.compile(
    "[\x21-\x7e\xa1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u0621-\u063a\u0641-\u064a"
    "\u3001-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]+"
)
_ready: dict[str, "Encoder"] = {}


class Encoder:
    """A byte-level tokenizer in a worker.

    Ordinary text is merged by tiktoken, given the vocabulary of the tokenizer's own file, in which the
    number of a token is its rank among the merges; texts that hold an added token go to tokenizers.
    """

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_buffer(definition)
        self.added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(definition), special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def count(self, chunk: str, whole: set[str]) -> int:
        """Tokens of a chunk: 1 for each pre-token that is proven whole; the rest is merged."""
        if chunk in whole:
            return 1
        if SETTLED.fullmatch(chunk, 1 if chunk.startswith(" ") else 0) and not any(a in chunk for a in self.added):
            return sum(1 if p in whole else len(self.fast.encode_ordinary(p)) for p in self.pattern.findall(chunk))
        return len(self.ids(chunk))

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks, and for all texts the indices of their chunks and where each text's begin."""
        uncut = pc.match_substring_regex(texts, UNCUT)
        for content in self.added:
            uncut = pc.or_(uncut, pc.match_substring(texts, content))
        cut = pc.split_pattern(pc.if_else(uncut, pa.scalar(""), texts), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        index, plain = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        first = np.zeros(len(index), bool)
        first[begin[:-1]] = True
        heads, head_at = np.unique(index[first], return_inverse=True)
        later, later_at = np.unique(index[~first], return_inverse=True)
        whole = texts.filter(uncut).to_pylist()
        chunks = [plain[i] for i in heads] + whole + [" " + plain[i] for i in later]
        out = np.empty(len(index), np.int64)
        out[first] = head_at
        out[~first] = later_at + len(heads) + len(whole)
        out[begin[:-1][uncut.to_numpy(zero_copy_only=False)]] = np.arange(len(whole)) + len(heads)
        return chunks, out, begin


def ranks(definition: bytes) -> dict[bytes, int]:
    """The bytes of every ordinary token of a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # these bytes stand for themselves
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found = json.loads(definition)
    added = {t["id"] for t in found["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in found["model"]["vocab"].items() if i not in added}


def is_byte_level(definition: bytes) -> bool:
    """Whether a .json tokenizer is plain byte-level BPE with the pattern of public_tokenizers."""
    found = json.loads(definition)
    cut = found.get("pre_tokenizer") or {}
    return found.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and found["model"].get("type") == "BPE"


def encoder_of(sent) -> Encoder:
    token, definition = sent.value[:2]
    if token not in _ready:
        _ready.clear()
        _ready[token] = Encoder(definition)
    return _ready[token]


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts (column 1) hold about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else []
    for begin, end in zip(edges, [*edges[1:], len(group)], strict=True):
        yield batch.slice(begin, end - begin)


def whole_tokens(definition: bytes) -> set[str]:
    """The vocabulary strings that the library encodes, each alone, as exactly one token."""
    tokenizer = Tokenizer.from_buffer(definition)
    added = {t["content"] for t in json.loads(definition)["added_tokens"]}
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    pattern = regex.compile(public_tokenizers.PATTERN)
    return {t for i, (t, e) in enumerate(zip(texts, found, strict=True)) if e.ids == [i] and t not in added and "�" not in t and pattern.findall(t) == [t]}


def token_counts(spark: SparkSession, docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of docs, for a byte-level .json or a sentencepiece .model."""
    with open(path, "rb") as f:
        definition = f.read()
    picked = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    byte_level = path.endswith(".json") and is_byte_level(definition)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, definition, whole_tokens(definition) if byte_level else None))

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, whole = encoder_of(sent), sent.value[2]
        for batch in batches:
            for part in slices(batch):
                chunks, index, begin = encoder.cut(part.column(1))
                counts = np.fromiter((encoder.count(c, whole) for c in chunks), np.int64, len(chunks))[index]
                tokens = np.add.reduceat(counts, begin[:-1]) if len(part) else counts
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    def by_library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=definition)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            library = Tokenizer.from_buffer(definition)
            count = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["id", "n_bytes", "n_tokens"])

    schema = f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return picked.mapInArrow(by_chunk if byte_level else by_library, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
