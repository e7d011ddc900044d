"""Matching texts against the terms of topics, by an index of anchors.

Rules: a term of ASCII letters and digits matches as a whole word, a term of at most four characters with a capital with
its case; spaces and hyphens of a term are interchangeable and may be missing; a term of four characters or more may
have s or es after it; a term beyond ASCII matches anywhere. What an excluded term of a topic matches has no hits in
that topic. A term that is defined twice in a topic is hit twice.

Every term is posted under anchors, one of which a text must have if the term occurs in it: a term of one word under that
word and its endings, a phrase under the words that hold its rarest part (with the neighbours it may be joined to), a term
beyond ASCII under its rarest pair of characters. Rarest is what the fewest terms have, of these the longest. Texts give
their distinct words, and pairs beyond ASCII, once; these meet the index in an equi-join, and only what meets is a row. A
phrase, or a term longer than its pair, is then tested in its text; the others are hits already. The plan is the
same for any file of terms.

Three sizes: an index of a few thousand anchors is intersected with a text's words before any row is made, and texts stay
with their rows for the tests; up to BROADCAST_POSTINGS the words are rows that meet a broadcast index; a larger index and the
words are shuffled, each word dealt over SALTS so that one that is everywhere isn't one task's. In the latter
two only texts with something to test are joined again, by their keys.

Null texts match nothing; an empty table gives an empty one; very long texts are matched whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.tables import written
from newsloom.functions.text import each_of, nfkc, text_of
from newsloom.sources.config import Topic

DEFAULT_WEIGHT = 0.4
# What a word is made of, what may stand between the parts of a term, and after a term of some length.
WORD, GAP = "[A-Za-z0-9]", "[\\s\\-]?"
ENDINGS, LEAST_INFLECTED = ("", "s", "es"), 4
LONGEST_CASED = 4
#: Up to so many anchors are intersected with the words of a text, and up to so many postings are broadcast.
FEW_ANCHORS, BROADCAST_POSTINGS = 2_000, 100_000
SALTS = 16
#: A posting: its anchor, the term, and what is left to test in a text.
POSTINGS = pa.schema(
    [("anchor", pa.string()), ("topic_ord", pa.int32()), ("topic", pa.string()), ("pos", pa.int32()), ("keyword", pa.string()), ("excludes", pa.bool_()), ("weight", pa.float64()), ("cased", pa.bool_()), ("pattern", pa.string()), ("part", pa.string())]
)
BEYOND = "[^\\x00-\\x7F]"
PAIR = "(?s)(?=(.[^\\x00-\\x7F]|[^\\x00-\\x7F].))"


def is_cased(term: str) -> bool:
    return len(term) <= LONGEST_CASED and any(map(str.isupper, term))


def endings_of(term: str) -> tuple[str, ...]:
    """What may follow a term within its word."""
    return ENDINGS if len(term) >= LEAST_INFLECTED and term[-1].isalpha() else ("",)


def pieces_of(term: str) -> list[str]:
    """The parts of a term between spaces and hyphens."""
    return term.replace("-", " ").split() or [term]


def pattern_of(term: str) -> str:
    """The Java pattern of an ASCII term, in lower case for a lower-case text unless the term is cased.

    The first character stands before the test of what precedes it, so that most places of a text fail at one comparison.
    """
    said = term if is_cased(term) else term.lower()
    first, *rest = pieces_of(said)
    begin = re.escape(first[0])
    return f"(?U){begin}(?<!{WORD}{begin}){GAP.join([re.escape(first[1:]), *map(re.escape, rest)])}(?:{'|'.join(endings_of(said))})(?!{WORD})"


# --- the index ------------------------------------------------------------------------------------------------


def word_groups(term: str) -> list[list[str]]:
    """For each run of letters and digits of an ASCII term, the words of a text that can hold it."""
    said = term if is_cased(term) else term.lower()
    pieces = pieces_of(said)
    runs = [r for p in pieces for r in re.findall(f"{WORD}+", p)]
    joined, at = [False] * (len(runs) + 1), 0  # whether a run may be joined to the one before
    for before, piece in zip([None, *pieces], pieces, strict=False):
        joined[at] = bool(before) and bool(re.match(WORD, piece)) and bool(re.search(f"{WORD}$", before))
        at += len(re.findall(f"{WORD}+", piece))
    open_end = endings_of(said) if re.search(f"{WORD}$", said) else ("",)
    out = []
    for k in range(len(runs)):
        first = k
        while joined[first]:
            first -= 1
        last = k
        while joined[last + 1]:
            last += 1
        spans = [(i, j) for i in range(first, k + 1) for j in range(k, last + 1)]
        out.append(["".join(runs[i : j + 1]) + e for i, j in spans for e in (open_end if j == len(runs) - 1 else ("",))])
    return out


def pair_groups(part: str) -> list[list[str]]:
    """The pairs of characters of a lower-case term, or the character that it is, one of them beyond ASCII."""
    return [[part]] if len(part) == 1 else [[p] for p in map("".join, zip(part, part[1:], strict=False)) if not p.isascii()]


@dataclass
class Terms:
    """The postings of all definitions, and how a text is asked for anchors."""

    postings: DataFrame
    n: int
    #: All anchors, by kind, if they are few.
    few: dict[str, list[str]] | None
    kinds: set[str]


def kind_of(anchor: str) -> str:
    if anchor in ("", "="):
        return "any"
    if anchor[0] == "=":
        return "cased"
    return "word" if anchor.isascii() else "one" if len(anchor) == 1 else "pair"


def definitions(topics: list[Topic], weights: dict[str, dict[str, float]]) -> Iterator[tuple]:
    for order, t in enumerate(topics):
        of = weights.get(t.name, {})
        for excludes, listed in ((False, t.terms), (True, t.exclude)):
            for i, k in enumerate(listed):
                yield order, t.name, i, k, excludes, 0.0 if excludes else float(of.get(k, DEFAULT_WEIGHT))


def term_table(spark: SparkSession, topics: list[Topic], weights: dict[str, dict[str, float]] | None = None) -> Terms:
    """The index of every occurrence of a term in the definitions."""
    rows, groups = list(definitions(topics, weights or {})), []
    for row in rows:
        term = unicodedata.normalize("NFKC", row[3]).strip()
        if term.isascii():
            prefix = "=" if is_cased(term) else ""
            whole = re.fullmatch(f"{WORD}+", term)
            groups.append(([[prefix + w for w in g] for g in word_groups(term)] or [[prefix]], None if whole else pattern_of(term), None))
        else:
            part = term.lower()
            groups.append((pair_groups(part) or [[""]], None, part if len(part) > 2 else None))
    used = Counter(a for options, _, _ in groups for g in options for a in g)
    columns: list[list] = [[] for _ in POSTINGS]
    for row, (options, pattern, part) in zip(rows, groups, strict=True):
        rarest = min(options, key=lambda g: (max(used[a] for a in g), -len(g[0]), g[0]))
        for anchor in dict.fromkeys(rarest):
            for column, value in zip(columns, (anchor, *row, anchor.startswith("="), pattern, part), strict=True):
                column.append(value)
    anchors: dict[str, list[str]] = {}
    for a in dict.fromkeys(columns[0]):
        anchors.setdefault(kind_of(a), []).append(a)
    few = anchors if sum(map(len, anchors.values())) <= FEW_ANCHORS else None
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, POSTINGS, strict=True)], schema=POSTINGS)
    postings = spark.createDataFrame(table)
    if few is None:  # rows of the driver come in thousands of small partitions
        postings = written(spark, postings.coalesce(SALTS), "postings")
    return Terms(postings, len(table), few, set(anchors))


# --- texts ----------------------------------------------------------------------------------------------------


def anchors_of(text: Column, lowered: Column, terms: Terms) -> Column:
    """The distinct anchors that a text has, of the kinds that terms are posted under; of a few only those that occur among terms."""
    not_words = f"[^{WORD[1:]}+"
    cased = f"(?<!{WORD})((?=[a-z0-9]*[A-Z]){WORD}{{1,{LONGEST_CASED + max(map(len, ENDINGS))}}})(?!{WORD})"
    beyond = lambda found: F.when(text.rlike(BEYOND), found).otherwise(F.array().cast("array<string>"))
    given = {
        "word": F.split(lowered, not_words),
        "cased": F.regexp_extract_all(text, F.lit(cased), 1),
        "one": beyond(F.regexp_extract_all(lowered, F.lit(f"({BEYOND})"), 1)),
        "pair": beyond(F.regexp_extract_all(lowered, F.lit(PAIR), 1)),
        "any": F.array(F.lit(""), F.lit("=")),  # terms without a letter or digit
    }
    out = []
    for kind in sorted(terms.kinds):
        found = given[kind]
        if terms.few:
            bare = [a[1:] for a in terms.few[kind]] if kind == "cased" else terms.few[kind]
            found = F.array_intersect(found, F.from_json(F.lit(json.dumps(bare)), "array<string>"))
        else:
            found = F.array_distinct(found)
        out.append(F.transform(found, lambda w: F.concat(F.lit("="), w)) if kind == "cased" else found)
    return F.concat(*out) if out else F.array().cast("array<string>")


def occurs(text: Column, lowered: Column) -> Column:
    """Whether what a posting leaves to test is in the text."""
    return F.when(F.col("pattern").isNotNull(), F.rlike(F.when(F.col("cased"), text).otherwise(lowered), F.col("pattern"))).when(F.col("part").isNotNull(), F.contains(lowered, F.col("part"))).otherwise(True)


def hits(texts: DataFrame, terms: Terms) -> DataFrame:
    """(keys..., topic_ord, topic, hits) for texts (keys..., text): what each text hits of each topic, exclusion applied.

    hits: structs of pos, keyword and weight. The keys tell texts apart: rows with equal keys count as one text.
    """
    keys = [c for c in texts.columns if c != "text"]
    clean = texts.select(F.struct(*keys).alias("row"), nfkc(text_of("text")).alias("text")).withColumn("lowered", F.lower("text"))
    asked = clean.withColumn("anchors", anchors_of(F.col("text"), F.col("lowered"), terms))
    posted = ["topic_ord", "topic", "pos", "keyword", "excludes", "weight"]
    to_test = F.col("pattern").isNotNull() | F.col("part").isNotNull()
    if terms.few is not None:
        met = each_of(asked, "anchors", "anchor", "row", "text", "lowered").join(F.broadcast(terms.postings), "anchor")
        met = met.where(occurs(F.col("text"), F.col("lowered"))).select("row", *posted)
    else:
        words = each_of(asked, "anchors", "anchor", "row")
        if terms.n <= BROADCAST_POSTINGS:
            found = words.join(F.broadcast(terms.postings), "anchor")
        else:
            salted = terms.postings.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
            found = words.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["anchor", "salt"])
        left = found.where(to_test).select("row", F.struct(*posted, "cased", "pattern", "part").alias("posting"))
        tested = left.groupBy("row").agg(F.collect_list("posting").alias("postings")).join(clean, "row")
        tested = tested.select("row", "text", "lowered", F.explode("postings").alias("posting")).select("row", "text", "lowered", "posting.*")
        met = found.where(~to_test).select("row", *posted).unionByName(tested.where(occurs(F.col("text"), F.col("lowered"))).select("row", *posted))
    hit = F.struct("pos", "keyword", "weight")
    grouped = met.groupBy("row", "topic_ord", "topic").agg(F.max("excludes").alias("vetoed"), F.array_sort(F.collect_set(F.when(~F.col("excludes"), hit))).alias("hits"))
    return grouped.where("NOT vetoed AND size(hits) > 0").select(*[F.col("row").getField(k).alias(k) for k in keys], "topic_ord", "topic", "hits")


def matched_keywords(column: str | Column = "hits") -> Column:
    """Keywords of a column of hits, in the order of their definition."""
    return F.transform(column, lambda h: h["keyword"])


def match_topics(spark: SparkSession, rows: DataFrame, topics: list[Topic], id_column: str, text_column: str) -> DataFrame:
    """(id, topic_ord, topic, keywords) of the topics that each row's text is about."""
    texts = rows.select(id_column, F.col(text_column).alias("text"))
    return hits(texts, term_table(spark, topics)).select(id_column, "topic_ord", "topic", matched_keywords().alias("keywords"))


def vetoes(spark: SparkSession, rows: DataFrame, topics: list[Topic], id_column: str = "ord") -> DataFrame:
    """(id, veto): the first topic not to be collected that the title hits, or two different keywords in the summary."""
    fields = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("summary").alias("field"), F.col("summary").alias("text"))))
    texts = rows.select(id_column, fields.alias("x")).select(id_column, "x.field", "x.text")
    found = hits(texts, term_table(spark, topics))
    enough = (F.col("field") == "title") | (F.size(F.array_distinct(matched_keywords())) >= 2)
    return found.where(enough).groupBy(id_column).agg(F.min_by("topic", "topic_ord").alias("veto"))
