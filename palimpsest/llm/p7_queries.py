"""Queries of documents packed into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.packing import pack_documents, packing_report
from palimpsest.llm.tokens import with_token_counts
from palimpsest.session import read_table


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_token_counts(read_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return pack_documents(sized, read_table(spark, sf_dir, "container_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing_report(p7_packed(spark, sf_dir), read_table(spark, sf_dir, "container_sizes"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
