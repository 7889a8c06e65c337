"""Queries of linked name spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.names import link_spellings, name_mentions, spelling_pairs
from palimpsest.session import read_table

_SCOPE = ["tenant_id", "scope"]


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name spelling with the canonical spelling of its entity."""
    spellings, listed = name_mentions(read_table(spark, sf_dir, "entity_items"), read_table(spark, sf_dir, "fact_frames"))
    return link_spellings(spellings, listed, _SCOPE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(p5_entities(spark, sf_dir), _SCOPE)


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities}
