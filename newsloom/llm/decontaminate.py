"""Benchmark decontamination with an Aho-Corasick automaton over windows of normalised items.

Items and documents are normalised alike: A-Z is lower-cased and words are runs of digits, a-z and
everything beyond ASCII. Every window of `width` consecutive item words (or the whole of a shorter
item) is a pattern, and a document is scanned once. Hits are mapped back to words and to character
offsets of the original text.

The patterns are a test set, whose size is checked before it is sent out: an automaton holds at most
`max_pattern_chars` characters of patterns (items above that by themselves excepted). A larger
benchmark is cut into blocks of whole items by a hash; the documents then pass one automaton after
the other and carry their hits along in a column, written to the shared folder between blocks.

Results for odd input: a null or empty text has no words and no hits; items without an id or without
words are ignored; an item id that occurs twice counts once; a window that several items share hits each
of them; very long texts are scanned like others, a text at a time; repeated documents are each returned;
columns that aren't named are passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import fresh, table, written

WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
NORMAL = bytes(c if 0x30 <= c <= 0x39 or c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() and c < 0x80 else 0x20 for c in range(256))
MAX_PATTERN_CHARS = 4_000_000

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_built: dict[str, tuple] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows_of(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    words = normal_words(text)
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def automaton(items: list[tuple[str, str]], width: int) -> tuple:
    """The automaton, and for each window its number of words and its items.

    Bytes stand as the characters of the same number, so that matching is on UTF-8 bytes; a space on
    both sides keeps matches on word boundaries.
    """
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for window in windows_of(text, width):
            owners.setdefault(window, set()).add(item)
    found = ahocorasick.Automaton()
    sizes, names = [], []
    for i, (window, of) in enumerate(sorted(owners.items())):
        found.add_word(b" ".join((b"", *window, b"")).decode("latin-1"), i)
        sizes.append(len(window))
        names.append(sorted(of))
    found.make_automaton()
    return found, sizes, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def word_hits(text: str | None, built: tuple) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged spans of hit words, items with an occurring window."""
    words = normal_words(text)
    found, sizes, names = built
    if not words or not sizes:
        return len(words), [], set()
    line = b" ".join((b"", *words, b"")).decode("latin-1")
    spans, items, at, done = [], set(), 0, -1
    for end, window in found.iter(line):
        done += line.count(" ", at, end + 1)
        at = end + 1
        spans.append((done - sizes[window], done))
        items.update(names[window])
    return len(words), merged(spans), items


def _scanner(items, width: int):
    """A UDF (text, hits so far) -> hits; each Python worker builds the automaton once."""
    token = uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if token not in _built:
            _built.clear()
            _built[token] = automaton(items.value, width)
        for texts, before in batches:
            rows = []
            for text, had in zip(texts.to_pylist(), before.to_pylist(), strict=True):
                n, spans, names = word_hits(text, _built[token])
                if had:
                    spans, names = merged(spans + list(zip(had["starts"], had["ends"], strict=True))), names | set(had["items"])
                rows.append({"n_words": n, "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(names)})
            yield pa.array(rows, pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return scan.asNondeterministic()  # so that it isn't run again for each use of its fields


def with_hits(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    max_pattern_chars: int = MAX_PATTERN_CHARS,
    column: str = "benchmark_hits",
) -> DataFrame:
    """docs with a column of hits: n_words, starts and ends of hit runs of words, items (sorted)."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).cast("string").alias("words")).dropna()
    chars = items.agg(F.sum(F.octet_length("words")).alias("n")).first().n or 0
    blocks = max(1, -(-chars * width // max_pattern_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    out = docs.withColumn(column, F.lit(None).cast(HITS))
    for block in range(blocks):
        if block:
            out = written(spark, out, "hits")
        part = dealt.where(F.col("block") == block).select("item", "words").collect()  # a bounded block of a test set
        sent = spark.sparkContext.broadcast([(r.item, r.words) for r in part])
        out = out.withColumn(column, _scanner(sent, width)(F.col(text_column), F.col(column)))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.arrow_udf(SPANS)
def original_spans(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Character offsets [start, end) in the original text of runs of hit words."""
    rows = []
    for text, first, last in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        at = [m.span() for m in WORD.finditer(text)] if first else []
        rows.append([{"start": at[s][0], "end": at[e - 1][1]} for s, e in zip(first, last, strict=True)])
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def contaminated_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(id, spans, items) of the documents with a hit; spans are offsets in the original text."""
    hits = with_hits(spark, docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("words_of")), benchmark, "words_of", **options)
    hit = hits.where(F.size("benchmark_hits.items") > 0)
    spans = original_spans("words_of", "benchmark_hits.starts", "benchmark_hits.ends").alias("spans")
    return hit.select(F.col("id").alias(id_column), spans, F.col("benchmark_hits.items").alias("items"))


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    found = fresh("hits")
    hits = with_hits(spark, docs, benchmark, column=found, **options)
    return hits.where(F.size(f"{found}.items") == 0).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = with_hits(spark, docs, table(spark, sf_dir, "benchmark")).select("doc_id", "benchmark_hits.*")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return hit.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)
  WHERE len(w) > 0),
ip AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM ip),
ks AS (SELECT DISTINCT k FROM i),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
hits AS (SELECT DISTINCT dw.doc_id, dw.p, dw.k, iw.item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM dp) dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
hp AS (SELECT DISTINCT doc_id, p, k FROM hits),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hp) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
