"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import alignment, chroma, decontaminate, katz, langid, linefreq, negatives, outliers, packing, quality, sharding, simhash, tokens
from newsloom.llm.common import with_small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_scores": katz.query,
    "op2_decontaminate": decontaminate.query,
    "op3_harmonic_packing": packing.query,
    "op4_simhash_groups": simhash.query,
    "op5_language": langid.query,
    "op6_token_counts": tokens.query,
    "op7_chroma": chroma.query,
    "op8_quality": quality.query,
    "op9_byte_shards": sharding.query,
    "op10_line_frequency": linefreq.query,
    "op11_outliers": outliers.query,
    "op12_alignment": alignment.query,
    "op13_hard_negatives": negatives.query,
}
QUERIES = {name: with_small_batches(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL,
    "op10_line_frequency": linefreq.SQL,
    "op13_hard_negatives": negatives.SQL,
}
