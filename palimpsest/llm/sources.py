"""The text columns that the problems name, in one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import read_table

_COLUMNS = {"memory_writes": ("write_id", "text"), "memories": ("memory_id", "text"), "fact_frames": ("fact_id", "evidence")}


def texts(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """(src, id, text) of whole tables; rows repeat as they are stored."""
    parts = [read_table(spark, sf_dir, t).select(F.lit(t).alias("src"), F.col(_COLUMNS[t][0]).alias("id"), F.col(_COLUMNS[t][1]).alias("text")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
