"""Documents whose statistics don't fit their language and source: minimum covariance determinant.

Every text gives counts of words, their characters, symbols, repeated lines and repeated windows of three words,
all within its row. Four statistics are made of them: the logarithm of the mean length of a word, and, as
angles (the arc sine of the root), the shares of symbols among words and symbols, of repeated lines and of repeated
words. For each language and source the location and scatter of these vectors are estimated from that half of
the documents whose scatter has the least determinant; a document is rejected if its Mahalanobis distance
from there is beyond a quantile of chi square.

The half is found by concentration steps from two deterministic starts: the median with the median absolute
deviations, and the median with the correlation of the vectors' hyperbolic tangents. A step measures all
documents by the scatter it has and takes the nearest half for the next one; the start with the less
determinant counts. Then follow the consistency factor, one step over all documents within the 0.975 quantile,
and the verdict. FLOORS are added to the deviations, since most documents repeat nothing and have no symbols.

Everything is a DataFrame expression. A step is one aggregation of all documents: of each estimate and narrow bin of
squared distances it keeps number, sums and sums of products, and the nearest half is the least run of whole bins that
holds half the documents. Statistics are whole numbers of 1/SCALE, so sums are exact in any order and a run repeats
to the last bit. Medians come from counts of values the same way. So no task holds a group, however large it is,
and estimates join documents by broadcast or, where there are many, by a salted key.

Repeated windows are told by sorting 64-bit words of hash and place; windows whose hash parts meet are compared by
their words, and a text in which different ones meet is sorted by the words themselves. It takes about 150 bytes of
memory for each word of a row.

Groups of fewer than LEAST_ROWS documents that pass the base rules are judged by the estimate of their language, and
languages of fewer by that of all documents. Those that fail the base rules have no part in estimates.

Results for odd input: a null text is an empty one; it has no words, fails the base rules and isn't kept; a null
language or source is a value of its own; very long texts are counted whole; ties in distance are in one bin, so they
are within the half or beyond it together; repeated rows count each; rows with a null id are judged like others; an
empty table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import new_path, scratch, table, written

#: What is between words, what is in them, and what counts as a symbol.
GAP, WORD_CHARACTER, SYMBOL = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]", "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
WINDOW = 3
#: Statistics are whole numbers of this part, within +-LARGEST.
SCALE, LARGEST = 1024, 8 * 1024
#: Names of the statistics, and the least deviation of each.
STATISTICS = ("length", "symbols", "lines", "repeats")
FLOORS = (0.06, 0.08, 0.15, 0.15)
#: So many lines without repetition are added to each text: a few lines tell little.
PRIOR_LINES = 8
P = len(STATISTICS)
LEAST_ROWS = 200
MOST_STEPS = 20
#: Squared distances are told apart in so many parts of an octave.
BINS = 16
REWEIGHTED, REJECTED = 0.975, 1 - 1e-4
#: Up to so many estimates are broadcast.
BROADCAST_ESTIMATES = 50_000
SALTS = 32
CONSISTENT_MAD = 1.4826  # fixed value: the median absolute deviation of a normal variable is 1 / 1.4826
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


# --- counts ---------------------------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def covered(starts: Column) -> Column:
    """How many words the windows at these sorted places cover together."""
    widths = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)).cast("int")))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)


def with_repeats(rows: DataFrame, hash_of: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """rows (words, n_words) with n_repeat_words."""
    words, n = F.col("words"), F.col("n_words").cast("int")
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    several = n > WINDOW
    hashes = F.when(several, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: hash_of(*window(i)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("hashes", hashes).withColumn("some", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    # places of windows in the order of their hash: the lower bits of a hash make room for the place
    rows = rows.withColumn("room", F.pow(F.lit(2.0), F.ceil(F.log2(n + 1))).cast("long"))
    part = lambda h: h - F.pmod(h, F.col("room"))
    packed = F.sort_array(F.transform("hashes", lambda h, i: part(h) + i))
    rows = rows.withColumn("packed", F.when(F.col("some"), packed))
    near = lambda x, k: F.coalesce(part(F.get("packed", k)) == part(x), F.lit(False))
    place = lambda x: F.pmod(x, F.col("room")).cast("int")
    met = F.transform("packed", lambda x, k: F.when(near(x, k - 1) | near(x, k + 1), place(x)))
    rows = rows.withColumn("met", F.array_compact(met))
    # windows that meet by their hashes alone: then by the words
    same = lambda a, b: F.array(*window(a)) == F.array(*window(b))
    differ = F.transform("met", lambda x, k: (part(F.get("hashes", x)) == part(F.get("hashes", F.get("met", k - 1)))) & ~same(x, F.get("met", k - 1)))
    rows = rows.withColumn("differ", F.coalesce(F.array_contains(differ, F.lit(True)), F.lit(False)))
    told = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array(*window(i)).alias("window"), i.alias("at"))))
    rows = rows.withColumn("told", F.when(F.col("differ"), told))
    equal = lambda x, k: F.coalesce(F.get("told", k)["window"] == x["window"], F.lit(False))
    exact = F.array_compact(F.transform("told", lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["at"])))
    rows = rows.withColumn("starts", F.sort_array(F.when(F.col("differ"), exact).otherwise(F.col("met"))))
    return rows.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered(F.col("starts"))).otherwise(F.lit(0).cast("long")))


def counted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) of each row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(by[0]).cast("string").alias("lang"), F.col(by[1]).cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_CHARACTER))
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": lines})
    rows = rows.select(
        "id", "lang", "source", "words", F.size("words").cast("long").alias("n_words"), (F.length("text") - F.regexp_count("text", F.lit(GAP))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return with_repeats(rows).select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", failed.alias("base_failed"))


def statistics() -> list[Column]:
    """The vector of a row of counts, in whole numbers of 1/SCALE."""
    angle = lambda share: F.asin(F.sqrt(share))
    n = F.col("n_words")
    values = (
        F.log(F.col("word_chars") / n),
        angle(F.col("n_symbols") / (F.col("n_symbols") + n)),
        angle(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)),
        angle(F.col("n_repeat_words") / n),
    )
    whole = [F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.round(v * SCALE))).cast("long") for v in values]
    return [w.alias(f"x{i}") for i, w in enumerate(whole)]


# --- groups ---------------------------------------------------------------------------------------------------


def group_table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(lang, source, judged, feeds): which estimate judges a language and source, and which ones their documents feed.

    An estimate's key is (level, lang, source): 2 with both, 1 with the language alone, 0 with neither.
    """
    fit = F.sum((~F.col("base_failed")).cast("long"))
    groups = written(spark, rows.groupBy("lang", "source").agg(fit.alias("n")), "groups")
    none = F.lit(None).cast("string")
    key = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    small = F.col("n") < LEAST_ROWS
    by_lang = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.max(small).alias("asks"))
    by_lang = by_lang.withColumn("asks_all", F.col("asks") & (F.col("n_lang") < LEAST_ROWS))
    asks_all = bool(by_lang.agg(F.max("asks_all")).first()[0])
    joined = groups.join(by_lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    own, language, everything = key(2, F.col("lang"), F.col("source")), key(1, F.col("lang"), none), key(0, none, none)
    large = F.col("n_lang") >= LEAST_ROWS
    feeds = F.array(F.when(~small, own), F.when(F.col("asks") & large, language), F.when(F.lit(asks_all), everything))
    return joined.select("lang", "source", F.when(~small, own).when(large, language).otherwise(everything).alias("judged"), F.array_compact(feeds).alias("feeds"))


def met_with(spark: SparkSession, rows: DataFrame, small: DataFrame, keys: list[str], limit: int = BROADCAST_ESTIMATES) -> DataFrame:
    """rows with what a written table of groups or estimates says of them; their keys may be null.

    A table of many rows is repeated SALTS times, and rows are dealt among these, so that no key's rows are one task's.
    """
    names = {k: f"small_{k}" for k in keys}
    on = lambda: [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    small = small.withColumnsRenamed(names)
    if small.count() <= limit:
        return rows.join(F.broadcast(small), on()).drop(*names.values())
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(SALTS)))
    repeated = small.withColumn("small_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(repeated, [*on(), F.col("salt") == F.col("small_salt")]).drop(*names.values(), "salt", "small_salt")


# --- estimates ------------------------------------------------------------------------------------------------


def medians(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) the median of each key of counts (keys, value, n): the least value that half lie at or below."""
    # at most one row for each whole number that a statistic can have
    order = Window.partitionBy(*keys).orderBy(value)
    sums = counts.withColumns({"so_far": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return sums.where(2 * F.col("so_far") >= F.col("all")).groupBy(*keys).agg(F.min(value).alias(value))


def starting(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Estimates (key, start, m*, c*) that the steps begin with."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(P)]))
    counts = written(spark, vectors.select("key", values.alias("v")).groupBy("key", "v.i", "v.x").agg(F.count("*").alias("n")), "values")
    centre = medians(counts, ["key", "i"], "x")
    apart = counts.join(centre.withColumnRenamed("x", "m"), ["key", "i"]).select("key", "i", F.abs(F.col("x") - F.col("m")).alias("x"), "n")
    spread = medians(apart.groupBy("key", "i", "x").agg(F.sum("n").alias("n")), ["key", "i"], "x")
    both = centre.join(spread.withColumnRenamed("x", "d"), ["key", "i"])
    wide = both.groupBy("key").agg(*[f(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(P) for c, f in (("x", F.max), ("d", F.max))])
    deviation = [F.sqrt((F.col(f"d{i}") * CONSISTENT_MAD / SCALE) ** 2 + FLOORS[i] ** 2).alias(f"s{i}") for i in range(P)]
    robust = written(spark, wide.select("key", *[(F.col(f"x{i}") / SCALE).alias(f"m{i}") for i in range(P)], *deviation), "robust")
    # the vectors' hyperbolic tangents, as whole numbers, and their sums of products
    bent = met_with(spark, vectors, robust, ["key"])
    bent = bent.select("key", *[F.round(F.tanh((F.col(f"x{i}") / SCALE - F.col(f"m{i}")) / F.col(f"s{i}")) * SCALE).cast("long").alias(f"x{i}") for i in range(P)])
    found = moments(bent.groupBy("key").agg(*sums_of()), 0)
    related = lambda i, j: F.coalesce(F.try_divide(F.col(f"c{i}{j}"), F.sqrt(F.col(f"c{i}{i}") * F.col(f"c{j}{j}"))), F.lit(0.0))
    related_of = found.select(F.col("key").alias("of"), *[related(i, j).alias(f"r{i}{j}") for i, j in PAIRS if i != j])
    rows = robust.join(related_of, F.col("key").eqNullSafe(F.col("of")))
    centres = [f"m{i}" for i in range(P)]
    plain = [(F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    bent_too = [(F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else F.col(f"r{i}{j}"))).alias(f"c{i}{j}") for i, j in PAIRS]
    first = rows.select("key", F.lit(0).alias("start"), *centres, *plain)
    return first.unionByName(rows.select("key", F.lit(1).alias("start"), *centres, *bent_too))


def sums_of() -> list[Column]:
    """Number, sums and sums of products of the vectors, all of them whole."""
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"t{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"t{i}{j}") for i, j in PAIRS]]


def added() -> list[Column]:
    """The same over rows of such sums."""
    return [F.sum(c).alias(c) for c in ("n", *[f"t{i}" for i in range(P)], *[f"t{i}{j}" for i, j in PAIRS])]


def moments(rows: DataFrame, floors: float = 1.0) -> DataFrame:
    """Estimates of rows of sums: means m* and covariances c*, floors added to the variances."""
    others = [c for c in rows.columns if c[0] != "t"]
    mean = [(F.col(f"t{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(P)]
    product = lambda i, j: (F.col(f"t{i}{j}") / F.col("n") - F.col(f"t{i}") / F.col("n") * F.col(f"t{j}") / F.col("n")) / SCALE**2
    return rows.select(*others, *mean, *[(product(i, j) + (floors * FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])


def whitened(rows: DataFrame) -> DataFrame:
    """rows with the inverse w* of the Cholesky factor of their covariances c*, and the logarithm of the determinant."""
    factor = lambda i, j: F.col(f"l{i}{j}")
    total = lambda terms: sum(terms, F.lit(0.0))
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") - total(factor(i, k) * factor(j, k) for k in range(j))
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / factor(j, j))
    for i in range(P):
        rows = rows.withColumns({f"w{i}{j}": (F.lit(1.0) if i == j else -total(factor(i, k) * F.col(f"w{k}{j}") for k in range(j, i))) / factor(i, i) for j in range(i + 1)})
    return rows.withColumn("log_det", 2 * total(F.log(factor(i, i)) for i in range(P))).drop(*[f"l{i}{j}" for i, j in PAIRS])


def distance() -> Column:
    """The squared Mahalanobis distance of x* from m* by w*."""
    part = lambda i: sum(((F.col(f"x{j}") / SCALE - F.col(f"m{j}")) * F.col(f"w{i}{j}") for j in range(i + 1)), F.lit(0.0))
    return sum((part(i) ** 2 for i in range(P)), F.lit(0.0))


def concentrated(spark: SparkSession, vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Sums over the nearest half of each estimate's documents."""
    starts = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    far = met_with(spark, starts, estimates, ["key", "start"]).withColumn("bin", F.floor(BINS * F.log2(distance() + 2.0**-20)).cast("int"))
    binned = far.groupBy("key", "start", "bin").agg(*sums_of())
    group = Window.partitionBy("key", "start")  # at most a row for each bin
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.floor((F.sum("n").over(group) + P + 1) / 2)
    nearest = binned.withColumns({"before": before, "half": half, "all": F.sum("n").over(group)}).where(F.col("before") < F.col("half"))
    return nearest.groupBy("key", "start").agg(*added(), F.max("all").alias("all"))


def chi_square(x: float, freedom: int) -> float:
    """The chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def quantile(share: float, freedom: int = P) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return low


def inflated(rows: DataFrame, share: Column) -> DataFrame:
    """Estimates from the nearest `share` of their documents, whose covariances are made those of all of a normal variable."""
    rows = rows.withColumns({"share": F.least(share, F.lit(0.99)), "q": F.lit(quantile(0.3))})
    half = F.col("q") / 2
    for _ in range(14):  # Newton's method from below the root of a concave function
        rows = rows.withColumn("q", F.col("q") + (F.col("share") - (1 - F.exp(-half) * (1 + half))) / (half / 2 * F.exp(-half)))
    factor = F.col("share") / (1 - F.exp(-half) * (1 + half + half**2 / 2))
    return rows.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor for i, j in PAIRS}).drop("share", "q")


def estimates_of(spark: SparkSession, vectors: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """(key, m*, w*) the estimate of each key of vectors (key, x*), a written table."""
    now = written(spark, whitened(starting(spark, vectors)).select("key", "start", *_named()), "estimates")
    halves = None
    for _ in range(most_steps):
        after = written(spark, concentrated(spark, vectors, now), "halves")
        if halves is not None and after.exceptAll(halves).limit(1).count() == 0:
            break
        halves = after
        now = written(spark, whitened(moments(halves)).select("key", "start", *_named()), "estimates")
    fitted = moments(halves)
    best = whitened(fitted).groupBy("key").agg(F.min_by(F.struct(*[c for c in fitted.columns if c != "key"]), F.struct("log_det", "start")).alias("best"))
    raw = inflated(best.select("key", "best.*"), F.col("n") / F.col("all"))
    raw = written(spark, whitened(raw).select("key", *_named()), "raw")
    within = met_with(spark, vectors, raw, ["key"]).where(distance() <= quantile(REWEIGHTED))
    final = moments(within.groupBy("key").agg(*sums_of()))
    limit = quantile(REWEIGHTED)
    factor = REWEIGHTED / chi_square(limit, P + 2)
    final = final.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor for i, j in PAIRS})
    return written(spark, whitened(final).select("key", *_named()), "final")


def _named() -> tuple[str, ...]:
    return (*[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i, j in PAIRS])


def judged(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The counts of each row of docs with distance (squared; null where the base rules fail) and kept."""
    rows = written(spark, counted(docs, id_column, text_column, by), "counts")
    passed = rows.where(~F.col("base_failed"))
    groups = written(spark, group_table(spark, rows), "judged")
    fit = met_with(spark, passed.select("id", "lang", "source", *statistics()), groups.drop("judged"), ["lang", "source"])
    fit = written(spark, fit.select(F.explode("feeds").alias("key"), *[f"x{i}" for i in range(P)]), "vectors")
    final = estimates_of(spark, fit).withColumnRenamed("key", "judged")
    by_group = groups.drop("feeds").join(final, "judged").drop("judged")
    met = met_with(spark, passed.select("*", *statistics()), written(spark, by_group, "estimates-by-group"), ["lang", "source"])
    told = met.withColumn("distance", distance()).select(*rows.columns, "distance", (F.col("distance") <= quantile(REJECTED)).alias("kept"))
    return told.unionByName(rows.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    with scratch(spark):
        found = judged(spark, table(spark, sf_dir, "documents"))
        kept = written(spark, found, "verdicts", new_path(spark, "verdicts"))
    return kept.select(F.col("id").alias("doc_id"), *columns)
