"""Queries of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.neardup import NearDupConfig, near_duplicate_groups, near_duplicate_pairs
from palimpsest.llm.sources import texts

#: The problem's own measure: single words in any order, counted with repetition, 70 % shared, 30 words at least.
CONFIG = NearDupConfig(words_per_shingle=1, threshold=0.7, min_words=30, bands=76, rows_per_band=7)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(texts(spark, sf_dir, "memory_writes", "memories"), "src", "id", "text", CONFIG)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long text with its class of equal words, its group of near copies and its number of links."""
    return near_duplicate_groups(texts(spark, sf_dir, "memory_writes", "memories"), "src", "id", "text", CONFIG)


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
