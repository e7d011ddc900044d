"""Words of a text without spaces: the cheapest path through the lattice of a caller's dictionary.

A lexicon is two files of a common layout: words, one `surface,left,right,cost,pos,kind,...` a line (CSV), and
connections, one `right left cost` a line (numbers). A path costs its words and, between neighbours, the connection
of the first one's right number with the second one's left number; 0 is the number of both ends of a text.
Connections that aren't listed cost nothing.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import NOUN, nfkc

WORDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("surface", "pos", "kind")]))
MAX_LEXICON_BYTES = 256 << 20  # what a broadcast may hold; dictionaries of a language have some tens of megabytes
#: Characters of one kind: an unknown word is one character, or what follows of its kind, up to LONGEST_UNKNOWN.
RUNS = re.compile("[ァ-ヺー]+|[ぁ-ゖ]+|[一-鿿々]+|[^\\W_ぁ-ヺー一-鿿々]+|[\\W_]")
LONGEST_UNKNOWN = 24  # without a bound a path might stay open to the end of a text
SETTLE_EVERY = 4096


@dataclass(frozen=True)
class Entry:
    left: int
    right: int
    cost: int
    pos: str
    kind: str


@dataclass
class Lexicon:
    """words by surface; an unknown word costs `unknown`, has the number 0 on both sides and counts as a noun."""

    words: dict[str, list[Entry]]
    connections: dict[tuple[int, int], int]
    unknown: Entry = Entry(0, 0, 10000, NOUN, "一般")
    lengths: dict[str, list[int]] = field(init=False)

    def __post_init__(self) -> None:
        found = defaultdict(set)
        for w in self.words:
            found[w[0]].add(len(w))
        self.lengths = {c: sorted(ns) for c, ns in found.items()}

    def join(self, right: int, left: int) -> int:
        return self.connections.get((right, left), 0)


def parse_lexicon(words: Iterable[str], connections: Iterable[str] = (), unknown: Entry = Lexicon.unknown) -> Lexicon:
    """The lexicon of the lines of both files; a blank surface is no word, a header of two numbers is passed over."""
    entries = defaultdict(list)
    for row in csv.reader(words):
        if len(row) >= 5 and row[0]:
            entries[row[0]].append(Entry(int(row[1]), int(row[2]), int(row[3]), row[4], row[5] if len(row) > 5 else ""))
    costs = [tuple(map(int, line.split())) for line in connections if len(line.split()) == 3]
    return Lexicon(dict(entries), {(r, left): c for r, left, c in costs}, unknown)


class _Node:
    """A word on the cheapest path up to its end; paths that nothing leads on from are freed with their last node."""

    __slots__ = ("cost", "before", "start", "end", "entry")

    def __init__(self, cost: int, before: _Node | None, start: int, end: int, entry: Entry) -> None:
        self.cost, self.before, self.start, self.end, self.entry = cost, before, start, end, entry


def candidates(text: str, at: int, run_end: int, lexicon: Lexicon) -> Iterator[tuple[int, Entry]]:
    """(end, entry) of each word that may begin there: the dictionary's, the character alone, the rest of its run."""
    for n in lexicon.lengths.get(text[at], ()):
        for entry in lexicon.words.get(text[at : at + n], ()) if at + n <= len(text) else ():
            yield at + n, entry
    yield at + 1, lexicon.unknown
    if run_end > at + 1:
        yield run_end, lexicon.unknown


def cut(text: str, lexicon: Lexicon) -> Iterator[tuple[str, Entry]]:
    """(surface, entry) of the words of the cheapest path; of equal ones that whose last word begins first.

    Characters are met once each. Words are given out as soon as all open paths agree on them, so memory goes with
    the stretch on which they differ, not with the text.
    """
    origin = _Node(0, None, 0, 0, Entry(0, 0, 0, "", ""))
    reached: dict[int, dict[int, _Node]] = {0: {0: origin}}  # by end and right number
    settled = 0  # where the words that were given out end
    for run in RUNS.finditer(text):
        for at in range(run.start(), run.end()):
            here = reached.pop(at)
            by_left: dict[int, _Node | tuple] = {}
            for end, entry in candidates(text, at, min(run.end(), at + LONGEST_UNKNOWN), lexicon):
                if entry.left not in by_left:
                    by_left[entry.left] = min(((n.cost + lexicon.join(r, entry.left), n.start, i, n) for i, (r, n) in enumerate(here.items())))
                cost, _, _, before = by_left[entry.left]
                ends = reached.setdefault(end, {})
                if entry.right not in ends or cost + entry.cost < ends[entry.right].cost:
                    ends[entry.right] = _Node(cost + entry.cost, before, at, end, entry)
            if (at + 1) % SETTLE_EVERY == 0:
                common = _common([n for ends in reached.values() for n in ends.values()])
                if common.end > settled:
                    yield from _words(text, common, settled)
                    settled, common.before = common.end, None
    last = min(((n.cost + lexicon.join(r, 0), n.start, i, n) for i, (r, n) in enumerate(reached[len(text)].items())))[-1]
    yield from _words(text, last, settled)


def _common(nodes: list[_Node]) -> _Node:
    """The last node that is on the way to all of them: always the one that ends last goes a step back."""
    open_ = {id(n): n for n in nodes}
    while len(open_) > 1:
        latest = max(open_.values(), key=lambda n: n.end)
        del open_[id(latest)]
        open_[id(latest.before)] = latest.before
    return next(iter(open_.values()))


def _words(text: str, node: _Node | None, after: int) -> list[tuple[str, Entry]]:
    found = []
    while node is not None and node.end > after:
        found.append((text[node.start : node.end], node.entry))
        node = node.before
    return found[::-1]


def words_udf(spark: SparkSession, lexicon: Lexicon):
    """A function of a text column: its words in order as array<struct<surface, pos, kind>>, spaces left out.

    The lexicon is broadcast, up to MAX_LEXICON_BYTES. Null stays null; an empty text has no words. Texts of any
    length are cut whole.
    """
    size = sum(len(w.encode()) + 64 * len(es) for w, es in lexicon.words.items()) + 64 * len(lexicon.connections)
    if size > MAX_LEXICON_BYTES:
        raise ValueError(f"a lexicon of {size} bytes is too large to be broadcast")
    shared = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf(WORDS)
    def words(texts: pa.Array) -> pa.Array:
        lexicon = shared.value
        row = lambda t: [{"surface": s, "pos": e.pos, "kind": e.kind} for s, e in cut(t, lexicon) if not s.isspace()]
        return pa.array([None if t is None else row(t.as_py()) if t.as_py() else [] for t in (x if x.is_valid else None for x in texts)], _arrow_type())

    return words


def _arrow_type() -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.string()) for n in ("surface", "pos", "kind")]))


def segmented(spark: SparkSession, text: str | Column, lexicon: Lexicon) -> Column:
    """The words of the text's normal form, as noun_terms takes them."""
    return words_udf(spark, lexicon)(nfkc(text))
