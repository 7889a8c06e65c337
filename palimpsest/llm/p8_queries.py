"""Queries of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.mixing import mix_report, mix_sources
from palimpsest.llm.tokens import with_token_counts
from palimpsest.session import read_table


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_token_counts(read_table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mix_sources(sized, read_table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each listed source."""
    return mix_report(p8_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
