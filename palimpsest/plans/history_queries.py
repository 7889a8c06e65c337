"""Queries of the interval and history operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.history import fact_history, state_history
from palimpsest.operators.intervals import periods_and_gaps
from palimpsest.session import read_table

_KEYS = ["tenant_id", "scope", "subject", "predicate"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(src: str) -> DataFrame:
        rows = read_table(spark, sf_dir, src).where(F.col("subject").isNotNull())
        return periods_and_gaps(rows, _KEYS, "valid_from", "valid_to").select(F.lit(src).alias("src"), *_KEYS, "piece", "from_s", "to_s")

    return one("fact_frames").unionByName(one("entity_relations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = [F.coalesce(F.unix_seconds(c), F.lit(-1)).alias(n) for c, n in (("from_at", "from_s"), ("to_at", "to_s"))]
    facts = fact_history(read_table(spark, sf_dir, "fact_frames")).select(
        F.lit("fact_frames").alias("src"), "tenant_id", "scope", F.col("subject").alias("entity"), F.col("predicate").alias("attribute"), "held_value", *secs
    )
    states = state_history(read_table(spark, sf_dir, "memory_records")).select(
        F.lit("memory_records").alias("src"), "tenant_id", F.lit("").alias("scope"), "entity", F.lit("state").alias("attribute"), "held_value", *secs
    )
    return facts.unionByName(states)


QUERIES = {"p2_found": p2_found, "p6_found": p6_found}

_P6_ONE = """
SELECT '{src}' AS src, tenant_id, scope, subject, predicate, valid_from AS f, coalesce(valid_to, TIMESTAMPTZ '9999-12-31 00:00:00+00') AS t
FROM {src} WHERE subject IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)"""

SQL = {
    "p6_found": f"""
WITH iv AS ({_P6_ONE.format(src="fact_frames")} UNION ALL {_P6_ONE.format(src="entity_relations")}),
reach AS (SELECT *, max(t) OVER (PARTITION BY src, tenant_id, scope, subject, predicate ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
isl AS (SELECT *, sum(CASE WHEN before IS NULL OR before < f THEN 1 ELSE 0 END) OVER (PARTITION BY src, tenant_id, scope, subject, predicate ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS no FROM reach),
per AS (SELECT src, tenant_id, scope, subject, predicate, no, min(f) AS f, max(t) AS t FROM isl GROUP BY ALL),
nxt AS (SELECT *, lead(f) OVER (PARTITION BY src, tenant_id, scope, subject, predicate ORDER BY f) AS n FROM per)
SELECT src, tenant_id, scope, subject, predicate, 'period' AS piece, CAST(epoch(f) AS BIGINT) AS from_s, CASE WHEN year(t) = 9999 THEN -1 ELSE CAST(epoch(t) AS BIGINT) END AS to_s FROM per
UNION ALL
SELECT src, tenant_id, scope, subject, predicate, 'gap', CAST(epoch(t) AS BIGINT), CAST(epoch(n) AS BIGINT) FROM nxt WHERE n IS NOT NULL""",
    "p2_found": """
WITH ff AS (SELECT DISTINCT 'fact_frames' AS src, tenant_id, scope, subject AS entity, predicate AS attribute, CASE WHEN coalesce(polarity, 1) >= 0 THEN lower(trim(object_value)) END AS v, asserted_at AS a, fact_id AS tie
  FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND asserted_at IS NOT NULL),
mr AS (SELECT 'memory_records' AS src, tenant_id, '' AS scope, CAST(memory_id AS VARCHAR) AS entity, 'state' AS attribute, s AS v, snapshot_at AS a, 0 AS tie FROM (
  SELECT *, lower(trim(state)) AS s, row_number() OVER (PARTITION BY memory_id, snapshot_at ORDER BY loaded_at DESC NULLS LAST, lower(trim(state)) DESC) AS rn
  FROM memory_records WHERE state IS NOT NULL AND trim(state) <> '' AND snapshot_at IS NOT NULL AND memory_id IS NOT NULL) WHERE rn = 1),
al AS (SELECT *, coalesce('v' || v, 'x') AS m FROM (SELECT * FROM ff UNION ALL SELECT * FROM mr)),
ch AS (SELECT *, lag(m) OVER (PARTITION BY src, tenant_id, scope, entity, attribute ORDER BY a, tie, m) AS p FROM al),
st AS (SELECT *, lead(a) OVER (PARTITION BY src, tenant_id, scope, entity, attribute ORDER BY a, tie, m) AS n FROM ch WHERE p IS NULL OR p <> m)
SELECT src, tenant_id, scope, entity, attribute, v AS held_value, CAST(epoch(a) AS BIGINT) AS from_s, CASE WHEN n IS NULL THEN -1 ELSE CAST(epoch(n) AS BIGINT) END AS to_s FROM st WHERE v IS NOT NULL""",
}
