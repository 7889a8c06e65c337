"""Queries of the consistent form of look-alike texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.canonical import same_look_pairs, with_canonical
from palimpsest.llm.sources import texts


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(texts(spark, sf_dir, "memory_writes", "memories"), "src", "id", "text")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return with_canonical(texts(spark, sf_dir, "memory_writes", "memories"), "text", "form").select("src", "id", "form")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
