"""Queries of personal data in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.pii import pii_items, redacted
from palimpsest.llm.pii_training import trained_weights
from palimpsest.llm.sources import texts

_TABLES = ("memory_writes", "memories", "fact_frames")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pii_items(texts(spark, sf_dir, *_TABLES), ["src", "id"], "text", trained_weights())
    return items.select("src", F.col("id").alias("row_id"), "pii_type", "pii_text").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its items replaced by typed placeholders."""
    return redacted(texts(spark, sf_dir, *_TABLES), ["src", "id"], "text", trained_weights())


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
