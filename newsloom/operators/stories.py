"""Stories: titles that tell the same news, found by the overlap of their rare tokens.

Similarity is the Jaccard index of token sets, weighted by inverse document frequency. Titles with equal
token sets are one class, and only classes are compared. Two sets at a similarity of t or more share a
token within each one's prefix: its tokens from the rarest on, until what is left weighs less than t of
the whole. So the join runs over prefixes, where common tokens hardly occur, and loses no pair.

Clustering by leaders: in their order, titles join the most similar leader before them (the later one
of equals) at the threshold or above, or else lead a story themselves. A class leads if no leading class
before it is similar. Blocks of classes are decided one after the other, each as large as all before it; what is like a leader
found so far isn't compared with anything but leaders any more. So a story of n titles makes pairs
in proportion to n, unless its titles follow each other late in the order: then those of one block are compared.

Similarities are compared rounded to 12 digits, so that the order of a sum can't decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.tables import written
from newsloom.functions.text import each_of

# Thresholds and factors.
SAME_STORY = 0.30
DIVERSITY = 0.18
REP_RATIO = 0.8
BUZZ_PER_SOURCE = 0.08
BUZZ_MAX_SOURCES = 10
DIGITS = 12
#: What bounds allow for the order of a sum.
SLACK = 1e-9
#: Classes that are decided first, and at least at once; how many others each of a block may meet by their prefixes.
FIRST_BLOCK, SMALLEST_BLOCK, MEETINGS = 4096, 256, 64


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n + 1)) / (df + 1)) + 1


def document_frequencies(titles: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df, idf) over all titles (an array of distinct tokens each)."""
    n = max(1, titles.count())
    return each_of(titles, tokens, "token").groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", idf(F.col("df"), n))


def token_key(tokens: str = "tokens") -> Column:
    return F.sha2(F.array_join(F.array_sort(tokens), "\x1f"), 256)


def token_classes(titles: DataFrame, order: str = "ord", tokens: str = "tokens") -> DataFrame:
    """(class_id, tokens) of distinct non-empty token sets; class_id is the least order number."""
    held = titles.where(F.size(tokens) > 0).select(F.col(order), F.col(tokens).alias("tokens"), token_key(tokens).alias("key"))
    return held.groupBy("key").agg(F.min(order).alias("class_id"), F.first("tokens").alias("tokens"))


def weighed(classes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(class_id, token, weight, total, rest) of classes (class_id, tokens); rest: the weight of this token and the commoner ones."""
    tokens = each_of(classes, "tokens", "token", "class_id").join(frequencies.select("token", F.col("idf").alias("weight")), "token")
    of_class = Window.partitionBy("class_id")  # the tokens of one title
    rest = of_class.orderBy("weight", F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumns({"total": F.sum("weight").over(of_class), "rest": F.sum("weight").over(rest)})


def in_prefix(threshold: float) -> Column:
    return F.col("rest") >= F.col("total") * (threshold - SLACK)


def similar(left: DataFrame, right: DataFrame, threshold: float, condition: Column | None = None) -> DataFrame:
    """(a, b, similarity) of all classes of left and of right (rows of `weighed`) at the threshold or above.

    A pair meets at each token that both have in their prefix. At the rarest token that both have, what they share
    can't be more than the lesser of their rests; where that is too little the pair isn't made. That loses no pair,
    since a similar one passes at that token. Of what was made, those whose shared tokens, and the lesser rest after the
    last of them, are too little go before any other token is looked at.
    """
    side = lambda name, rows: rows.where(in_prefix(threshold)).select("token", "weight", F.col("class_id").alias(name), F.col("total").alias(f"total_{name}"), F.col("rest").alias(f"rest_{name}"))
    least, needed = F.least("total_a", "total_b"), (F.col("total_a") + F.col("total_b")) * (threshold / (1 + threshold)) - SLACK
    near = (least >= F.greatest("total_a", "total_b") * (threshold - SLACK)) & (F.least("rest_a", "rest_b") >= needed)
    met = side("a", left).join(side("b", right).drop("weight"), "token").where(near if condition is None else near & condition)
    after = F.least(*[F.min(F.col(f"rest_{x}") - F.col("weight")) for x in "ab"])
    candidates = met.groupBy("a", "b", "total_a", "total_b").agg((F.sum("weight") + after).alias("most")).where(F.col("most") >= needed).drop("most")
    shared = candidates.join(left.select(F.col("class_id").alias("a"), "token", "weight"), "a").join(right.select(F.col("class_id").alias("b"), "token"), ["b", "token"])
    summed = shared.groupBy("a", "b", "total_a", "total_b").agg(F.sum("weight").alias("both"))
    similarity = F.round(F.col("both") / (F.col("total_a") + F.col("total_b") - F.col("both")), DIGITS)
    return summed.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_classes(classes: DataFrame, frequencies: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for all pairs of classes (class_id, tokens) at the threshold or above, a < b."""
    rows = weighed(classes, frequencies)
    return similar(rows, rows, threshold, F.col("a") < F.col("b"))


def first_ones(spark: SparkSession, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class_id): of classes, the first ones of which no two are in pairs (a before b). All are decided at once, in rounds."""
    nodes = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct().withColumn("leads", F.lit(None).cast("boolean"))
    while True:
        before = pairs.select("a", F.col("b").alias("class_id")).join(nodes.select(F.col("class_id").alias("a"), F.col("leads").alias("a_leads")), "a")
        seen = before.groupBy("class_id").agg(F.max(F.coalesce("a_leads", F.lit(False))).alias("led"), F.max(F.col("a_leads").isNull()).alias("waits"))
        decided = F.when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        nodes = written(spark, nodes.join(seen, "class_id", "left").select("class_id", F.coalesce("leads", decided).alias("leads")), "leaders")
        if nodes.where("leads IS NULL").limit(1).count() == 0:
            return classes.select("class_id").join(nodes.where("NOT leads").select("class_id"), "class_id", "left_anti")


def placed(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(class_id, at): classes numbered in their order, by a range partitioning and the sizes of its parts."""
    parts = written(spark, classes.select("class_id").orderBy("class_id").withColumn("part", F.spark_partition_id()), "parts")
    before = F.sum("n").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("class_id"))
    return parts.join(F.broadcast(offsets), "part").select("class_id", (number - 1 + F.col("before")).alias("at"))


def block_end(block: DataFrame, begin: int, end: int, threshold: float) -> int:
    """Where a block should end so that its classes meet MEETINGS others each at most; but not below a fourth of what is decided."""
    at = end
    while at - begin > max(SMALLEST_BLOCK, begin // 4):
        n = block.where(F.col("at") < at).where(in_prefix(threshold)).groupBy("token").agg(F.count("*").alias("n"))
        met = n.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        if met <= MEETINGS * (at - begin):
            break
        at = begin + (at - begin) // 2
    return at


def leading(spark: SparkSession, tokens: DataFrame, classes: DataFrame, threshold: float, first_block: int = FIRST_BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(class_id) of the leaders among classes, and the pairs that were made to tell them.

    tokens: rows of `weighed`. Blocks of classes are decided in their order, each twice as large as what is decided. Within a block
    its similar pairs decide; then the classes that remain meet the block's leaders, and those like one are done
    with. So the later members of a story never meet each other, and there are as many rounds as doublings.
    """
    numbered = written(spark, placed(spark, classes), "placed")
    rows = written(spark, tokens.join(numbered, "class_id"), "undecided")
    n, begin, found, made = numbered.count(), 0, [], []
    while begin < n:
        end = block_end(rows, begin, min(n, max(first_block, 2 * begin)), threshold)
        block = written(spark, rows.where(F.col("at") < end), "block")
        pairs = written(spark, similar(block, block, threshold, F.col("a") < F.col("b")), "pairs")
        made.append(pairs)
        found.append(written(spark, first_ones(spark, block.select("class_id").distinct(), pairs), "leading"))
        rest = rows.where(F.col("at") >= end)
        if end < n:
            like = similar(rest, block.join(found[-1], "class_id", "left_semi"), threshold).select(F.col("a").alias("class_id")).distinct()
            rows = written(spark, rest.join(like, "class_id", "left_anti"), "undecided")
        begin = end
    return (reduce(DataFrame.unionByName, found) if found else classes.select("class_id").limit(0)), made


def story_clusters(spark: SparkSession, titles: DataFrame, frequencies: DataFrame, threshold: float = SAME_STORY, first_block: int = FIRST_BLOCK) -> DataFrame:
    """(ord, story) of titles (ord, tokens), ord unique: the order number of the leader that a title joins, or its own.

    A title without tokens is a story of its own.
    """
    rows = titles.select("ord", token_key().alias("key"), "tokens")
    classes = written(spark, token_classes(rows), "classes")
    tokens = written(spark, weighed(classes, frequencies), "weighed")
    led = written(spark, leading(spark, tokens, classes, threshold, first_block)[0], "leaders")
    members = tokens.join(led, "class_id", "left_anti")
    near = similar(members, tokens.join(led, "class_id", "left_semi"), threshold).select(F.col("a").alias("class_id"), F.col("b").alias("leader"), "similarity")
    own = led.select("class_id", F.col("class_id").alias("leader"), F.lit(1.0).alias("similarity"))
    options = near.unionByName(own).groupBy("class_id").agg(F.collect_list(F.struct("similarity", "leader")).alias("options"))  # leaders differ, so they are few
    keyed = classes.join(options, "class_id").select("key", "options")
    joined = rows.where(F.size("tokens") > 0).join(keyed, "key")
    best = F.array_max(F.filter("options", lambda o: o["leader"] <= F.col("ord")))
    some = joined.select("ord", best["leader"].alias("story"))
    return some.unionByName(rows.where(F.size("tokens") == 0).select("ord", F.col("ord").alias("story")))


def representatives(members: DataFrame, ratio: float = REP_RATIO) -> DataFrame:
    """(story, rep, related) of members (story, ord, source, via, score), processed in the order of ord.

    The leader stands for its story, unless it came through a search and a member read directly has at
    least `ratio` of its score: then the first such member. related: the others' sources.
    """
    leading = members.where("ord = story").select("story", F.col("via").alias("leader_via"), F.col("score").alias("leader_score"))
    rows = members.join(leading, "story")
    better = (F.col("leader_via") != "RSS") & (F.col("via") == "RSS") & (F.col("score") >= ratio * F.col("leader_score"))
    reps = rows.groupBy("story").agg(F.coalesce(F.min(F.when(better, F.col("ord"))), F.col("story")).alias("rep"))
    own = members.join(reps.select(F.col("rep").alias("ord"), F.col("story").alias("rep_story")), "ord").select(F.col("rep_story").alias("story"), F.col("ord").alias("rep"), F.col("source").alias("rep_source"))
    sources = members.groupBy("story", "source").agg(F.count("*").alias("n"))
    listed = sources.join(own, "story").where("source <> rep_source").groupBy("story").agg(F.array_sort(F.collect_list("source")).alias("related"))
    return own.join(listed, "story", "left").select("story", "rep", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def buzz(related: str | Column = "related") -> Column:
    return 1 + BUZZ_PER_SOURCE * F.least(F.size(related), F.lit(BUZZ_MAX_SOURCES))
