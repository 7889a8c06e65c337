"""Queries of vectors and the life cycle of memories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import lifecycle as C
from palimpsest.operators import vectors as V
from palimpsest.session import read_table

NOW = "2026-03-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    r = V.exact_neighbours(read_table(spark, d, "embeddings"), "vec_id", "embedding", 20, 10)
    return r.select("query", "id", F.round("score", 4).alias("score"))


def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Weighted unit centroids of the embedding labels; a vector's weight is its id modulo 7 plus 1."""
    c = V.weighted_centroids(read_table(spark, d, "embeddings").where("embedding is not null"), "label", "embedding", (F.col("vec_id") % 7 + 1).cast("double"))
    return c.select("label", "dim", F.round("value", 5).alias("value"))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """For each vector the label whose centroid is nearest, by cosine; rows are projected, not shuffled."""
    e = read_table(spark, d, "embeddings").where("embedding is not null and label is not null").select("vec_id", "label", "embedding")
    return V.best_centroid(e.select("vec_id", "embedding"), "embedding", V.centroid_table(e, "label", "embedding"), "star")


def sign_hash_candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.sign_neighbours(read_table(spark, d, "embeddings"), "vec_id", "embedding", 64, 20, 10)


def injection_risk(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memory_writes").where("text is not null").select("write_id", F.round(T.injection_risk("text"), 6).alias("risk")).distinct()


def memory_kind(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memory_writes").where("text is not null").select("write_id", T.memory_kind("text", F.lower(F.trim("kind"))).alias("kind")).distinct()


def text_entities(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memory_writes").where("text is not null").select("write_id", F.concat_ws("|", T.text_entities("text", "entities")).alias("entities")).distinct()


def first_deliveries(writes: DataFrame) -> DataFrame:
    """One whole row per write_id: the delivery received first (unknown times come first), ties by the whole row."""
    rest = [c for c in writes.columns if c not in ("write_id", "received_at")]
    best = F.min(F.struct("received_at", *rest)).alias("_d")
    return writes.where("write_id is not null").groupBy("write_id").agg(best).select("write_id", "_d.*")


def write_gate(spark: SparkSession, d: str) -> DataFrame:
    """Gate probability of every write, with the greatest token overlap to any earlier write of its scope as similarity."""
    w = first_deliveries(read_table(spark, d, "memory_writes").where("text is not null").select("write_id", "received_at", "tenant_id", "scope", "text", "source", "explicit_importance", "entities", "written_at"))
    t = w.select("write_id", F.concat_ws("\x01", F.coalesce("tenant_id", F.lit("\x02")), F.coalesce("scope", F.lit("\x02"))).alias("part"), F.array_distinct(T.memory_tokens("text")).alias("tok"), "written_at")
    near = C.nearest_earlier(t, "write_id", "part", "written_at", "tok")
    w = w.join(near, "write_id", "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
    return C.write_features(w, "text", "source", "explicit_importance", "entities", F.col("near")).select("write_id", F.round("near", 6).alias("redundancy"), F.round("probability", 6).alias("probability"))


def decay_half_life(spark: SparkSession, d: str) -> DataFrame:
    m = C.decayed(_memories(spark, d), _now())
    return m.select("memory_id", F.round("mass", 6).alias("mass"), F.round("confidence", 6).alias("confidence"))


def retention_over_capacity(spark: SparkSession, d: str) -> DataFrame:
    m = _memories(spark, d).where("mass is not null and updated_at is not null and scope is not null")
    m = m.withColumn("source_trust", F.coalesce("confidence", F.lit(0.4))).withColumn("utility", F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 10.0))
    out = C.over_capacity(m, "scope", "memory_id", C.retention_score(_now()), 8)
    return out.select("scope", "memory_id", F.col("_s").alias("score"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One row per text stored more than once, with the memory that is kept and the merged mass.

    Each further copy adds 0.25 of its mass times the room left, in order of mass; that is 1 - product(1 - x).
    """
    m = _memories(spark, d).where("text is not null and text <> ''").select("memory_id", "text", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    best = Window.partitionBy("text").orderBy(F.col("mass").desc(), "memory_id")
    r = m.withColumn("rn", F.row_number().over(best))
    g = r.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min_by("memory_id", "rn").alias("kept"), F.product(1.0 - F.when(F.col("rn") == 1, F.col("mass")).otherwise(0.25 * F.col("mass"))).alias("room"))
    return g.where("copies > 1").select("kept", "copies", F.round(1.0 - F.col("room"), 6).alias("mass"))


def bitemporal_visible(spark: SparkSession, d: str) -> DataFrame:
    """Facts known on 1 June 2025 that hold on 1 July 2025."""
    f = read_table(spark, d, "fact_frames")
    at, known = F.lit("2025-07-01").cast("timestamp"), F.lit("2025-06-01").cast("timestamp")
    return f.where(C.bitemporal_visible(f, at, known, "valid_from", "valid_to", "recorded_at")).select("fact_id", "subject", "predicate").distinct()


def current_facts(spark: SparkSession, d: str) -> DataFrame:
    """The last asserted fact of each subject and predicate; older ones are shadows."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and object_value is not null and asserted_at is not null")
    g = f.groupBy("tenant_id", "scope", "subject", "predicate").agg(F.max_by(F.struct("fact_id", "object_value"), F.struct("asserted_at", "fact_id")).alias("b"), F.countDistinct("fact_id").alias("versions"))
    return g.select("tenant_id", "scope", "subject", "predicate", F.col("b.fact_id").alias("fact_id"), F.col("b.object_value").alias("object_value"), "versions")


def fact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Successive evidence texts of one subject and predicate that flip negation or share no number."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and evidence is not null and asserted_at is not null").select("tenant_id", "scope", "subject", "predicate", "fact_id", "evidence", "asserted_at").distinct()
    w = Window.partitionBy("tenant_id", "scope", "subject", "predicate").orderBy("asserted_at", "fact_id")
    f = f.withColumn("prev", F.lag("evidence").over(w)).withColumn("prev_id", F.lag("fact_id").over(w))
    return f.where(F.col("prev").isNotNull() & C.conflict("prev", "evidence")).select("fact_id", "prev_id")


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "memory_records").where("snapshot_at is not null")
    return r.groupBy("snapshot_at").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("memory_id").alias("memories"), F.count_if(F.col("active") == 1).alias("active"),
        F.count_if(F.lower(F.trim("state")) == "stable").alias("stable"), F.count_if(F.col("state").isNull()).alias("unknown"),
    ).select(F.unix_seconds("snapshot_at").alias("snapshot_s"), "rows", "memories", "active", "stable", "unknown")


QUERIES = {
    f.__name__: f
    for f in (
        cosine_topk, cluster_centroids, nearest_centroid, sign_hash_candidates, injection_risk, memory_kind, text_entities, write_gate, decay_half_life, retention_over_capacity,
        exact_duplicates, bitemporal_visible, current_facts, fact_conflicts, state_counts,
    )
}

_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_CASE = lambda key, table, default: "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {default}e0 END"
_TS = f"TIMESTAMPTZ '{NOW}+00'"
_DAYS = f"greatest(0.0e0, (epoch_us({_TS}) - epoch_us(updated_at)) / 86400000000.0e0)"
_ACTIONS = " + ".join(f"{T.sql_has_cue('text', [c])}::INT" for c in T.ACTION_CUES)
_NUM = "list_distinct(regexp_extract_all({x}, '[0-9]+(?:[.][0-9]+)?'))"
SQL = {
    "cosine_topk": f"SELECT query, id, round(score, 4) AS score FROM (SELECT q.vec_id AS query, e.vec_id AS id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) DESC, e.vec_id) AS rn FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) WHERE rn <= 10",
    "cluster_centroids": "WITH x AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT label, dim::INT AS dim, sum(v * w) AS s FROM x GROUP BY ALL) SELECT label, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 5) AS value FROM s",
    "nearest_centroid": f"WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT label, dim, sum(v) AS s FROM x GROUP BY ALL), c AS (SELECT label AS star, list(s ORDER BY dim) AS centre FROM (SELECT label, dim, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS s FROM s) GROUP BY label), p AS (SELECT vec_id, star, round({_DOT.format(a='embedding', b='centre')}, 5) AS score FROM embeddings, c) SELECT vec_id, star, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, star) AS rn FROM p) WHERE rn = 1",
    "injection_risk": f"SELECT DISTINCT write_id, round({T.sql_injection_risk('text')}, 6) AS risk FROM memory_writes WHERE text IS NOT NULL",
    "memory_kind": f"SELECT DISTINCT write_id, {T.sql_memory_kind('text', 'lower(trim(kind))')} AS kind FROM memory_writes WHERE text IS NOT NULL",
    "text_entities": f"SELECT DISTINCT write_id, array_to_string({T.sql_text_entities('text', 'entities')}, '|') AS entities FROM memory_writes WHERE text IS NOT NULL",
    "write_gate": f"""WITH w AS (SELECT write_id, tenant_id, scope, text, source, explicit_importance AS imp, entities, written_at FROM (SELECT *, row_number() OVER (PARTITION BY write_id ORDER BY received_at NULLS FIRST, tenant_id NULLS FIRST, scope NULLS FIRST, text NULLS FIRST, source NULLS FIRST, explicit_importance NULLS FIRST) AS rn FROM memory_writes WHERE text IS NOT NULL AND write_id IS NOT NULL) WHERE rn = 1),
t AS (SELECT *, list_distinct({T.sql_memory_tokens('text')}) AS tok, row_number() OVER (PARTITION BY tenant_id, scope ORDER BY written_at NULLS FIRST, write_id) AS ord FROM w),
b AS (SELECT a.write_id, max(CASE WHEN len(a.tok) = 0 OR len(b.tok) = 0 THEN 0.0e0 ELSE len(list_intersect(a.tok, b.tok)) / len(list_distinct(list_concat(a.tok, b.tok)))::DOUBLE END) AS near FROM t a JOIN t b ON a.tenant_id IS NOT DISTINCT FROM b.tenant_id AND a.scope IS NOT DISTINCT FROM b.scope AND b.ord < a.ord GROUP BY a.write_id),
n AS (SELECT t.*, coalesce(near, 0.0e0) AS near FROM t LEFT JOIN b USING (write_id)),
f AS (SELECT write_id, near, -0.85e0 + 1.8e0 * greatest(0.0e0, least(1.0e0, coalesce(imp, 0.0e0))) + 0.65e0 * (1.0e0 - near) + 1.1e0 * CASE WHEN {T.sql_has_cue('text', T.FUTURE_CUES)} THEN 0.55e0 ELSE 0 END + 1.35e0 * CASE WHEN {T.sql_has_cue('text', T.CORRECTION_CUES)} THEN 1.0e0 ELSE 0 END
 + {_CASE('lower(trim(source))', C.SOURCE_TRUST, 0.4)} + 0.35e0 * least(1.0e0, len({T.sql_text_entities('text', 'entities')}) / 5.0e0) + 0.75e0 * least(1.0e0, 0.35e0 * ({_ACTIONS})) - 0.55e0 * near - 3.2e0 * {T.sql_injection_risk('text')} AS z FROM n)
SELECT write_id, round(near, 6) AS redundancy, round(1.0e0 / (1.0e0 + exp(-greatest(-30.0e0, least(30.0e0, z)))), 6) AS probability FROM f""",
    "decay_half_life": f"""WITH f AS (SELECT *, CASE WHEN coalesce(pinned, false) THEN 1.0e0 ELSE exp(-ln(2.0e0) * coalesce({_DAYS}, 0.0e0) / {_CASE('lower(trim(kind))', C.HALF_LIFE_DAYS, 90.0)}) END AS k FROM memories)
SELECT memory_id, round(CASE WHEN k < 1 THEN greatest(0.03e0, mass * k) ELSE mass END, 6) AS mass, round(CASE WHEN k < 1 THEN greatest(0.05e0, confidence * sqrt(k)) ELSE confidence END, 6) AS confidence FROM f""",
    "retention_over_capacity": f"""WITH s AS (SELECT scope, memory_id, coalesce(pinned, false) AS pin, round(0.30e0 * mass + 0.25e0 * coalesce(confidence, 0.4e0) + 0.25e0 * least(1.0e0, coalesce(access_count, 0) / 10.0e0) + 0.20e0 * exp(-{_DAYS} / 90.0e0), 6) AS score FROM memories WHERE mass IS NOT NULL AND updated_at IS NOT NULL AND scope IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY scope) AS n, row_number() OVER (PARTITION BY scope, pin ORDER BY score, memory_id) AS low FROM s) SELECT scope, memory_id, score FROM r WHERE NOT pin AND low <= n - 8""",
    "exact_duplicates": "WITH r AS (SELECT memory_id, text, coalesce(mass, 0.0e0) AS mass, row_number() OVER (PARTITION BY text ORDER BY coalesce(mass, 0.0e0) DESC, memory_id) AS rn FROM memories WHERE text IS NOT NULL AND text <> '') SELECT arg_min(memory_id, rn) AS kept, count(*) AS copies, round(1.0e0 - product(1.0e0 - CASE WHEN rn = 1 THEN mass ELSE 0.25e0 * mass END), 6) AS mass FROM r GROUP BY text HAVING count(*) > 1",
    "bitemporal_visible": "SELECT DISTINCT fact_id, subject, predicate FROM fact_frames WHERE recorded_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND (valid_from IS NULL OR valid_from <= TIMESTAMPTZ '2025-07-01 00:00:00+00') AND (valid_to IS NULL OR TIMESTAMPTZ '2025-07-01 00:00:00+00' < valid_to)",
    "current_facts": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, scope, subject, predicate ORDER BY asserted_at DESC, fact_id DESC) AS rn FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND asserted_at IS NOT NULL) SELECT tenant_id, scope, subject, predicate, max(fact_id) FILTER (rn = 1) AS fact_id, max(object_value) FILTER (rn = 1) AS object_value, count(DISTINCT fact_id) AS versions FROM r GROUP BY ALL",
    "fact_conflicts": f"WITH f AS (SELECT DISTINCT tenant_id, scope, subject, predicate, fact_id, evidence, asserted_at FROM fact_frames WHERE subject IS NOT NULL AND evidence IS NOT NULL AND asserted_at IS NOT NULL), p AS (SELECT *, lag(evidence) OVER w AS prev, lag(fact_id) OVER w AS prev_id FROM f WINDOW w AS (PARTITION BY tenant_id, scope, subject, predicate ORDER BY asserted_at, fact_id)) SELECT fact_id, prev_id FROM p WHERE prev IS NOT NULL AND ({T.sql_has_cue('prev', T.NEGATIONS)} <> {T.sql_has_cue('evidence', T.NEGATIONS)} OR (len({_NUM.format(x='prev')}) > 0 AND len({_NUM.format(x='evidence')}) > 0 AND NOT list_has_any({_NUM.format(x='prev')}, {_NUM.format(x='evidence')})))",
    "state_counts": "SELECT CAST(epoch(snapshot_at) AS BIGINT) AS snapshot_s, count(*) AS rows, count(DISTINCT memory_id) AS memories, count(*) FILTER (active = 1) AS active, count(*) FILTER (lower(trim(state)) = 'stable') AS stable, count(*) FILTER (state IS NULL) AS unknown FROM memory_records WHERE snapshot_at IS NOT NULL GROUP BY snapshot_at",
}
