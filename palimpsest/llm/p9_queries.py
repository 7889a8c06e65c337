"""Queries of subject areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.subjects import document_subjects
from palimpsest.session import read_table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(*(read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas"))).distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each subject area; '' stands for documents about none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    by = docs.join(p9_found(spark, sf_dir), "doc_id", "left").groupBy(F.coalesce("subject", F.lit("")).alias("subject"))
    return by.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
