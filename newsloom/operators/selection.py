"""Selecting a few candidates: quotas of topics, caps of sources, and diversity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scores import rounded
from newsloom.functions.tables import written
from newsloom.functions.text import norm_name
from newsloom.operators.stories import DIGITS, DIVERSITY

#: Candidates that are asked for at once.
CHUNK = 16


def largest_remainders(shares: DataFrame, limit: int, name: str = "name", share: str = "share", order: str = "ord") -> DataFrame:
    """(name, quota) of shares (one row per topic): whole numbers, and one more for the largest remainders."""
    raw = F.col(share) * limit
    rows = shares.withColumns({"whole": F.floor(raw), "left": raw - F.floor(raw)})
    everything = Window.partitionBy()  # the topics of a configuration
    spare = F.greatest(F.lit(0).cast("long"), limit - F.sum("whole").over(everything))
    number = F.row_number().over(everything.orderBy(F.desc("left"), F.col(order)))
    return rows.select(name, (F.col("whole") + F.when(number <= spare, 1).otherwise(0)).alias("quota"))


def topic_order() -> list[Column]:
    """Candidates of a topic: what the topic itself gives them first, then their score."""
    return [F.desc(rounded(F.col("contrib") * F.col("fresh") * F.col("buzz"), 2)), F.desc("score"), F.asc("ord")]


def capped(rows: DataFrame, key: str, cap: int, *order: Column) -> DataFrame:
    """The first `cap` rows of each key; no window over a whole key is sorted beyond the cap."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", number).where(F.col("place") <= cap)


@dataclass
class Selection:
    ords: list = field(default_factory=list)
    capped: int = 0
    similar: int = 0
    #: Candidates that came to the driver.
    fetched: int = 0


WEIGHTS = "array<struct<token: string, idf: double>>"


class _Picks:
    """What is picked so far, at most `limit` rows: here for the few candidates that were fetched, and as columns for all others."""

    def __init__(self, cap: int, diversity: float):
        self.cap, self.diversity = cap, diversity
        self.rows: list = []
        self.sources: Counter = Counter()

    def allow(self, row) -> bool:
        mine = {t.token: t.idf for t in row.weights}
        return self.sources[row.source_key] < self.cap and all(self._unlike(mine, {t.token: t.idf for t in p.weights}) for p in self.rows)

    def _unlike(self, a: dict[str, float], b: dict[str, float]) -> bool:
        whole = sum((a | b).values())
        return not whole or round(sum(w for t, w in a.items() if t in b) / whole, DIGITS) < self.diversity

    def add(self, row) -> None:
        self.rows.append(row)
        self.sources[row.source_key] += 1

    def like(self, pick) -> Column:
        """Whether a row is too similar to this pick."""
        theirs = F.lit([t.token for t in pick.weights]) if pick.weights else F.array().cast("array<string>")
        shared = F.aggregate(F.filter("weights", lambda t: F.array_contains(theirs, t["token"])), F.lit(0.0), lambda a, t: a + t["idf"])
        whole = F.col("total") + sum(t.idf for t in pick.weights) - shared
        return F.arrays_overlap(F.col("weights.token"), theirs) & (F.round(shared / whole, DIGITS) >= self.diversity)

    def allowed(self) -> Column:
        """Whether a row may be taken after all picks; rows that are picked may not."""
        full = [s for s, n in self.sources.items() if n >= self.cap]
        out = ~F.col("source_key").isin(full) & ~F.col("ord").isin([p.ord for p in self.rows])
        for p in self.rows:
            out = out & ~self.like(p)
        return out

    def refused(self, key: Column, earlier: int, key_of: Callable) -> tuple[Column, Column]:
        """Whether a row was at its source's cap, and whether it was too similar, when its turn came.

        Before its turn were the first `earlier` picks, and of the others those with a lesser key.
        """
        before = [F.lit(True) if i < earlier else key_of(p) < key for i, p in enumerate(self.rows)]
        of_source = sum((F.when(b & (F.col("source_key") == p.source_key), 1).otherwise(0) for b, p in zip(before, self.rows, strict=True)), F.lit(0))
        alike = F.lit(False)
        for b, p in zip(before, self.rows, strict=True):
            alike = alike | (b & self.like(p))
        return of_source >= self.cap, (of_source < self.cap) & alike


def diverse_selection(reps: DataFrame, frequencies: DataFrame, quotas: list[tuple[str, int]], limit: int, cap: int, diversity: float = DIVERSITY, chunk: int = CHUNK) -> Selection:
    """Fills each topic's quota in topic_order, the largest quota first, and what is left by score.

    reps: ord, source, score, primary, contrib, fresh, buzz, tokens. A candidate is taken unless its source
    has `cap` picks or it is too similar to one, which depends on all picks before it. So each step asks Spark for the
    first few candidates that the picks so far allow; the first of them is a pick for certain, the others are
    if those before them allow it. At most `chunk` rows for each pick come to the driver, however many
    are refused; these are counted where they are, by what was picked before their turn.
    """
    empty = F.array().cast(WEIGHTS)
    words = reps.select("ord", F.explode("tokens").alias("token")).join(frequencies.select("token", "idf"), "token").groupBy("ord").agg(F.collect_list(F.struct("token", "idf")).alias("weights"))
    rank = rounded(F.col("contrib") * F.col("fresh") * F.col("buzz"), 2)
    keyed = reps.select("ord", norm_name("source").alias("source_key"), "primary", rank.alias("rank"), "score").join(words, "ord", "left").withColumn("weights", F.coalesce("weights", empty))
    rows = written(reps.sparkSession, keyed.withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, t: a + t["idf"])), "selectable")
    picks, result = _Picks(cap, diversity), Selection()

    def phase(of: DataFrame, columns: list[str], wanted: int) -> None:
        """Take up to `wanted` rows of these, by columns descending and ord ascending."""
        if wanted <= 0:
            return
        named = [f"k{i}" for i in range(len(columns))]
        key = F.struct(*[(-F.col(c)).alias(n) for c, n in zip(columns, named, strict=True)], "ord")
        key_of = lambda row: F.struct(*[F.lit(-row[c]).alias(n) for c, n in zip(columns, named, strict=True)], F.lit(row.ord).alias("ord"))
        earlier, got, last, more = len(picks.rows), 0, None, True
        while more:
            left = of.where(picks.allowed())
            left = left if last is None else left.where(key > key_of(last))
            found = left.orderBy(*[F.desc(c) for c in columns], "ord").limit(chunk).collect()
            result.fetched += len(found)
            for row in found:
                if picks.allow(row):
                    picks.add(row)
                    got += 1
                last = row
                if got == wanted:
                    break
            more = got < wanted and len(found) == chunk
        seen = of if got < wanted else of.where(key <= key_of(last))
        if picks.rows:
            at_cap, alike = picks.refused(key, earlier, key_of)
            counts = seen.where(~F.col("ord").isin([p.ord for p in picks.rows])).agg(F.count_if(at_cap).alias("capped"), F.count_if(alike).alias("similar")).first()
            result.capped += counts.capped
            result.similar += counts.similar

    for name, quota in sorted(quotas, key=lambda x: -x[1]):
        phase(rows.where(F.col("primary") == name), ["rank", "score"], quota)
    phase(rows, ["score"], limit - len(picks.rows))
    result.ords = [p.ord for p in picks.rows]
    return result
