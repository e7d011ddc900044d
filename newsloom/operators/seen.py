"""Links seen before, behind a membership filter: most new links pass without meeting the table of all links.

The filter is a Bloom filter in blocks of 32,768 bits, the size of Spark's bitmaps: a link's hash names its block, and
PROBES other hashes its bits there. Filters are tables (block, bits), kept by day if wanted: those of days, runs or
tasks are added up by OR, and one of 2^k blocks is folded to fewer by taking block numbers modulo these. A filter never
misses a link that was put in; what it takes for seen is looked up in the table of links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import normalize_url
from newsloom.operators.state import unseen

BLOCK_BITS = 32768  # fixed by bitmap_construct_agg
PROBES = 5
BITS_PER_LINK = 12  # about 5 in 1,000 new links are looked up in vain
BROADCAST_BLOCKS = 8192  # 32 MB


def blocks_for(links: int) -> int:
    """A power of two that gives each link its bits."""
    return 1 << max(0, (links * BITS_PER_LINK - 1) // BLOCK_BITS).bit_length()


def _block(link: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(link), F.lit(blocks))


def _bits(link: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(link, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(PROBES)]


def day_filters(rows: DataFrame, day: str, url: str, blocks: int) -> DataFrame:
    """(day, block, bits) of the rows' normalised links; blank and null links aren't put in.

    Links are made distinct first, so a link that fills a third of the rows is met once per task.
    """
    links = rows.where(F.col(url) != "").select(F.col(day).alias("day"), normalize_url(url).alias("link")).distinct()
    bits = links.select("day", _block(F.col("link"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("link")))).alias("bit"))
    return bits.groupBy("day", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_filter(filters: DataFrame, blocks: int) -> DataFrame:
    """One filter (block, bits) of filters of `blocks` blocks or of a multiple of them by a power of two."""
    return filters.groupBy(F.pmod("block", F.lit(blocks)).alias("block")).agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1


def with_possible(rows: DataFrame, url: str, filter_: DataFrame, blocks: int, name: str = "possibly_seen") -> DataFrame:
    """rows and whether the filter may hold their link; null and blank links aren't held.

    The filter is broadcast up to 32 MB. Beyond, rows go to their blocks, of which one link's rows share one; a link
    of very many rows is left to Spark's skew join.
    """
    link = normalize_url(url)
    sized = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    bits = sized.select(F.col("block").alias("filter_block"), F.col("bits").alias("filter_bits"))
    met = rows.join(bits, _block(link, blocks) == F.col("filter_block"), "left")
    held = F.col("filter_bits").isNotNull()
    for place in _bits(link):
        held = held & _is_set(F.col("filter_bits"), place)
    return met.withColumn(name, F.coalesce(held & (F.col(url) != ""), F.lit(False))).drop("filter_block", "filter_bits")


def unseen_by_filter(rows: DataFrame, seen: DataFrame, filter_: DataFrame, blocks: int, url_column: str = "link", seen_column: str = "link") -> DataFrame:
    """unseen(rows, seen) for a filter that holds all links of seen: only rows that it takes for seen are shuffled.

    rows are scanned twice.
    """
    mark = "__possibly_seen"
    met = with_possible(rows, url_column, filter_, blocks, mark)
    new, possible = met.where(~F.col(mark)).drop(mark), met.where(F.col(mark)).drop(mark)
    return new.unionByName(unseen(possible, seen, url_column, seen_column))
