"""Queries of the laws of mass, gates and memberships, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import formulas as P
from palimpsest.operators import vectors as V
from palimpsest.operators.pairing import rounded_column
from palimpsest.session import read_table


def mass_updates(spark: SparkSession, d: str) -> DataFrame:
    """Mass and orbit of each memory after the facts that different subjects tell of it and its use."""
    m = read_table(spark, d, "memories").where("mass is not null and memory_id is not null")
    f = read_table(spark, d, "fact_frames").where("memory_id is not null and subject is not null")
    seen = f.groupBy("memory_id").agg(F.countDistinct("subject").alias("sources"), F.max((F.col("polarity") < 0).cast("int")).alias("against"))
    j = m.select("memory_id", "mass", F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 10.0).alias("utility")).join(seen, "memory_id", "left")
    new = P.updated_mass(F.col("mass"), F.coalesce("sources", F.lit(0)), F.col("utility"), F.coalesce("against", F.lit(0)))
    return j.select("memory_id", F.round(new, 6).alias("mass"), F.round(P.orbit_radius(new), 6).alias("radius"))


def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Memories of one scope that follow each other in time and may be merged."""
    m = read_table(spark, d, "memories").where("text is not null and scope is not null and created_at is not null")
    m = m.select("scope", "memory_id", "kind", F.array_distinct(T.memory_tokens("text")).alias("tok"), "created_at")
    w = Window.partitionBy("scope").orderBy("created_at", "memory_id")
    p = m.select("scope", "memory_id", "tok", "kind", F.lag("memory_id").over(w).alias("before"), F.lag("tok").over(w).alias("ptok"), F.lag("kind").over(w).alias("pkind")).where("before is not null")
    s = T.jaccard(F.col("tok"), F.col("ptok"))
    ok = P.may_merge(s, F.coalesce(F.col("kind") == F.col("pkind"), F.lit(True)), F.lit(True), 0.6)
    return p.where(ok).select("scope", "before", "memory_id", F.round(s, 6).alias("similarity"))


def consolidation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and predicates of a scope whose facts agree well enough to be summed up."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and object_value is not null and scope is not null and predicate is not null")
    v = f.groupBy("scope", "subject", "predicate", F.lower(F.trim("object_value")).alias("v")).agg(F.countDistinct("fact_id").alias("n"), F.countDistinct(F.when(F.col("polarity") < 0, F.col("fact_id"))).alias("neg"), F.countDistinct("memory_id").alias("m"))
    g = v.groupBy("scope", "subject", "predicate").agg(F.sum("n").alias("evidence"), F.max("n").alias("top"), F.sum("neg").alias("neg"), F.sum("m").alias("m"))
    g = g.withColumns({"coherence": F.col("top") / F.col("evidence"), "conflict": F.col("neg") / F.col("evidence"), "diversity": F.col("m") / F.col("evidence")})
    g = g.where(P.may_consolidate(F.col("evidence"), F.col("coherence"), F.col("conflict"), F.col("diversity")))
    return g.select("scope", "subject", "predicate", "evidence", F.round("coherence", 6).alias("coherence"), F.round("conflict", 6).alias("conflict"))


def formation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Writes whose energy passes the gate, by importance, risk, length and entities."""
    w = read_table(spark, d, "memory_writes").where("text is not null and write_id is not null")
    w = w.select("write_id", F.coalesce("explicit_importance", F.lit(0.0)).alias("explicit"), F.least(F.lit(1.0), F.length("text") / 1000.0).alias("impact"), F.round(T.injection_risk("text"), 6).alias("risk"), F.least(F.lit(1.0), F.coalesce(F.size("entities"), F.lit(0)) / 5.0).alias("utility")).distinct()
    feats = {c: F.col(c) for c in ("explicit", "impact", "risk", "utility")}
    return w.select("write_id", F.round(P.write_energy(feats), 6).alias("energy"), P.may_write(feats, 1.0).alias("kept"))


def skill_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The predicate of each scope with the best record of affirmed facts, weighed by their confidence."""
    f = read_table(spark, d, "fact_frames").where("scope is not null and predicate is not null and fact_id is not null").select("scope", "predicate", "fact_id", "polarity", "confidence").distinct()
    g = f.groupBy("scope", "predicate").agg(F.count_if(F.col("polarity") > 0).alias("s"), F.count_if(F.col("polarity") < 0).alias("n"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    g = g.withColumn("score", F.round(P.skill_score(F.col("s"), F.col("n"), F.col("c")), 6))
    best = g.groupBy("scope").agg(F.max(F.struct("score", "predicate")).alias("b"))
    return best.select("scope", "b.predicate", "b.score")


def crowding(spark: SparkSession, d: str) -> DataFrame:
    """Scopes by mean mass, without the advantage of size."""
    m = read_table(spark, d, "memories").where("scope is not null and mass is not null").groupBy("scope").agg(F.count(F.lit(1)).alias("members"), F.avg("mass").alias("mean"))
    return m.select("scope", "members", F.round(P.crowd_corrected(F.col("mean") + 0.28 * F.log1p("members"), F.col("members"), 0.2), 6).alias("activation"))


def _cosines(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, star, score): every vector against the centroid of every label; the centroids travel as one array."""
    e = read_table(spark, d, "embeddings").where("embedding is not null and label is not null").select("vec_id", "label", "embedding")
    return V.against_centroids(e, "embedding", V.centroid_table(e, "label", "embedding"), "star")


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """Up to three clusters of each vector, by softmax over its cosines to their centroids."""
    return P.soft_memberships(_cosines(spark, d), "vec_id", "star", "score").select("vec_id", "star", "place")


def attachment_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well a cosine of 0.2 to a label's centroid tells the label."""
    return P.attachment_report(_cosines(spark, d).withColumn("truth", F.col("star") == F.col("label")), "vec_id", "score", "truth", 0.2)


def split_scores(spark: SparkSession, d: str) -> DataFrame:
    s = P.two_means(read_table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return s.select("label", F.round("balance", 4).alias("balance"), F.round("split_score", 4).alias("split_score"))


def storage_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "memories").agg(F.count(F.lit(1)).alias("rows")).withColumn("edges", F.col("rows") * 4)
    b = P.record_bytes(F.col("rows"), F.lit(384), F.col("edges"))
    return n.select("rows", *[c.cast("long").alias(k) for k, c in b.items()])


def spread_activation(spark: SparkSession, d: str) -> DataFrame:
    """Activation of entities two steps from those that people report to, along typed relations."""
    r = read_table(spark, d, "entity_relations").where("subject is not null and object_value is not null and predicate is not null").select("relation_id", "subject", "predicate", "object_value", "confidence").distinct()
    e = r.groupBy(F.col("subject").alias("src"), F.col("object_value").alias("dst"), F.col("predicate").alias("kind")).agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("weight"))
    start = e.where("kind = 'reports to'").select(F.col("src").alias("node")).distinct().withColumn("base", F.lit(1.0))
    a = P.activation_spread(e, start, {"reports to": 1.0, "works at": 0.5, "member of": 0.12, "depends on": -0.55}, 0.3, 2)
    return a.select("node", rounded_column(F.col("activation"), 5).alias("activation"))


QUERIES = {f.__name__: f for f in (mass_updates, merge_candidates, consolidation_gate, formation_gate, skill_ranking, crowding, memberships, attachment_quality, split_scores, storage_estimate, spread_activation)}

_TOK = T.sql_memory_tokens
_CLIP = "greatest(0.0e0, least(1.0e0, {}))"
_COS = """x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE label IS NOT NULL), s AS (SELECT label, dim, sum(v) AS s FROM x GROUP BY ALL),
c AS (SELECT label AS star, list(s ORDER BY dim) AS centre FROM (SELECT label, dim, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS s FROM s) GROUP BY label), p AS (SELECT vec_id, label, star, round(list_dot_product(embedding::DOUBLE[], centre::DOUBLE[]), 5) AS score FROM embeddings, c WHERE label IS NOT NULL)"""
SQL = {
    "mass_updates": f"""WITH s AS (SELECT memory_id, count(DISTINCT subject) AS n, max((polarity < 0)::INT) AS a FROM fact_frames WHERE memory_id IS NOT NULL AND subject IS NOT NULL GROUP BY memory_id),
u AS (SELECT memory_id, {_CLIP.format("mass + 0.10e0 * ln(1 + coalesce(n, 0)) + 0.15e0 * least(1.0e0, coalesce(access_count, 0) / 10.0e0) - 0.50e0 * coalesce(a, 0)")} AS m FROM memories LEFT JOIN s USING (memory_id) WHERE mass IS NOT NULL AND memory_id IS NOT NULL)
SELECT memory_id, round(m, 6) AS mass, round(1.0e0 + 9.0e0 * pow(1.0e0 - m, 1.25e0), 6) AS radius FROM u""",
    "merge_candidates": f"""WITH m AS (SELECT scope, memory_id, kind, list_distinct({_TOK('text')}) AS tok, created_at FROM memories WHERE text IS NOT NULL AND scope IS NOT NULL AND created_at IS NOT NULL),
p AS (SELECT *, lag(memory_id) OVER w AS before, lag(tok) OVER w AS ptok, lag(kind) OVER w AS pkind FROM m WINDOW w AS (PARTITION BY scope ORDER BY created_at, memory_id)),
j AS (SELECT *, CASE WHEN len(tok) = 0 OR len(ptok) = 0 THEN 0.0e0 ELSE len(list_intersect(tok, ptok)) / len(list_distinct(list_concat(tok, ptok)))::DOUBLE END AS s FROM p WHERE before IS NOT NULL)
SELECT scope, before, memory_id, round(s, 6) AS similarity FROM j WHERE s >= 0.6 AND coalesce(kind = pkind, true)""",
    "consolidation_gate": """WITH v AS (SELECT scope, subject, predicate, lower(trim(object_value)) AS v, count(DISTINCT fact_id) AS n, count(DISTINCT fact_id) FILTER (polarity < 0) AS neg, count(DISTINCT memory_id) AS m FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND scope IS NOT NULL AND predicate IS NOT NULL GROUP BY ALL),
g AS (SELECT scope, subject, predicate, sum(n)::BIGINT AS evidence, max(n) / sum(n)::DOUBLE AS coherence, sum(neg) / sum(n)::DOUBLE AS conflict, sum(m) / sum(n)::DOUBLE AS diversity FROM v GROUP BY ALL)
SELECT scope, subject, predicate, evidence, round(coherence, 6) AS coherence, round(conflict, 6) AS conflict FROM g WHERE evidence >= 2 AND coherence >= 0.55 AND conflict <= 0.30 AND diversity >= 0.35""",
    "formation_gate": f"""WITH w AS (SELECT DISTINCT write_id, coalesce(explicit_importance, 0.0e0) AS x, least(1.0e0, length(text) / 1000.0e0) AS i, round({T.sql_injection_risk('text')}, 6) AS r, least(1.0e0, coalesce(len(entities), 0) / 5.0e0) AS u FROM memory_writes WHERE text IS NOT NULL AND write_id IS NOT NULL),
e AS (SELECT *, 1.5e0 * u + 1.8e0 * x + 1.5e0 * i - 1.8e0 * r AS energy FROM w) SELECT write_id, round(energy, 6) AS energy, energy > 1.0 AND r < 0.82 AS kept FROM e""",
    "skill_ranking": """WITH f AS (SELECT DISTINCT scope, predicate, fact_id, polarity, confidence FROM fact_frames WHERE scope IS NOT NULL AND predicate IS NOT NULL AND fact_id IS NOT NULL),
g AS (SELECT scope, predicate, count(*) FILTER (polarity > 0) + 1.0e0 AS a, count(*) FILTER (polarity < 0) + 1.0e0 AS b, avg(coalesce(confidence, 0.0e0)) AS c FROM f GROUP BY ALL),
s AS (SELECT scope, predicate, round((a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) * (0.35e0 + 0.65e0 * c), 6) AS score FROM g)
SELECT scope, predicate, score FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, predicate DESC) AS rn FROM s) WHERE rn = 1""",
    "crowding": "SELECT scope, count(*) AS members, round(avg(mass) + 0.28e0 * ln(1 + count(*)) - 0.2e0 * ln(1 + count(*)), 6) AS activation FROM memories WHERE scope IS NOT NULL AND mass IS NOT NULL GROUP BY scope",
    "memberships": f"""WITH {_COS}, e AS (SELECT vec_id, star, exp((score - max(score) OVER (PARTITION BY vec_id)) / 0.8e0) AS e FROM p), q AS (SELECT vec_id, star, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, star)::INT AS place FROM q) SELECT vec_id, star, place FROM r WHERE place <= 3 AND probability >= 0.03""",
    "attachment_quality": f"""WITH {_COS}, r AS (SELECT vec_id, (star = label)::INT AS t, (score >= 0.2 AND rank() OVER (PARTITION BY vec_id ORDER BY score DESC) <= 3)::INT AS s FROM p),
k AS (SELECT vec_id, sum(t) AS tr, sum(s) AS pk, sum(t * s) AS hit FROM r GROUP BY vec_id)
SELECT round(coalesce(sum(hit) / nullif(sum(tr), 0)::DOUBLE, 0), 6) AS recall, round(coalesce(sum(pk - hit) / nullif(sum(pk), 0)::DOUBLE, 0), 6) AS contamination, round(coalesce(count(*) FILTER (tr = 0 AND pk > 0) / nullif(count(*) FILTER (tr = 0), 0)::DOUBLE, 0), 6) AS open_false_attachment,
round(coalesce(count(*) FILTER (tr = 0 AND pk = 0) / nullif(count(*) FILTER (tr = 0), 0)::DOUBLE, 0), 6) AS open_abstention, round(coalesce(count(*) FILTER (tr > 0 AND hit > 0) / nullif(count(*) FILTER (tr > 0), 0)::DOUBLE, 0), 6) AS coverage, round(avg(pk), 6) AS mean_attachments FROM k""",
    "storage_estimate": "SELECT count(*) AS rows, count(*) * 384 * 2 AS vector_bytes, count(*) * 96 AS state_bytes, count(*) * 4 * 24 AS edge_bytes FROM memories",
    "spread_activation": """WITH e AS (SELECT subject AS src, object_value AS dst, predicate AS kind, max(coalesce(confidence, 0.5e0)) AS weight FROM entity_relations WHERE subject IS NOT NULL AND object_value IS NOT NULL AND predicate IS NOT NULL GROUP BY ALL),
f AS (SELECT src, dst, CASE kind WHEN 'reports to' THEN 1.0e0 WHEN 'works at' THEN 0.5e0 WHEN 'member of' THEN 0.12e0 WHEN 'depends on' THEN -0.55e0 ELSE 0 END * weight / sum(weight) OVER (PARTITION BY src, kind) AS p FROM e),
b AS (SELECT DISTINCT src AS node, 1.0e0 AS base FROM e WHERE kind = 'reports to'),
m1 AS (SELECT dst AS node, sum(base * p) AS m FROM b JOIN f ON node = src WHERE p <> 0 GROUP BY dst), a1 AS (SELECT node, greatest(0.0e0, 0.7e0 * coalesce(base, 0) + 0.3e0 * coalesce(m, 0)) AS a FROM b FULL JOIN m1 USING (node)),
m2 AS (SELECT dst AS node, sum(a * p) AS m FROM a1 JOIN f ON node = src WHERE p <> 0 GROUP BY dst), a2 AS (SELECT node, greatest(0.0e0, 0.7e0 * coalesce(base, 0) + 0.3e0 * coalesce(m, 0)) AS a FROM b FULL JOIN m2 USING (node))
SELECT node, round(a, 5) AS activation FROM a2""",
}
