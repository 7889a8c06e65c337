"""Queries of answer reports, blended scores and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import capsules as K
from palimpsest.operators import learning as N
from palimpsest.session import read_table


def capsule_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the memories that facts come from, by windows of their scope in order of words shared with the evidence."""
    m = read_table(spark, d, "memories").where("scope is not null and text is not null and memory_id is not null").select("scope", "memory_id", F.array_distinct(T.memory_tokens("text")).alias("tok"))
    f = read_table(spark, d, "fact_frames").where("evidence is not null and memory_id is not null and scope is not null and fact_id % 20 = 0").select("fact_id", "scope", "memory_id", F.array_distinct(T.memory_tokens("evidence")).alias("q")).distinct()
    caps = K.window_capsules(m.select("scope", "memory_id"), ["scope"], ["memory_id"], "memory_id")
    one = caps.select("scope", "sources", F.explode("sources").alias("memory_id")).join(m, ["scope", "memory_id"]).groupBy("scope", "sources").agg(F.array_distinct(F.flatten(F.collect_list("tok"))).alias("tok"))
    j = f.select("fact_id", "scope", "q").distinct().join(one, "scope")
    j = j.withColumns({"s": F.round(T.overlap_share(F.col("q"), F.col("tok")), 6), "key": F.array_join(F.transform("sources", lambda x: x.cast("string")), ",")})
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.col("s").desc(), "key"))).where("rank <= 10")
    return N.capsule_recall(ranked, f, "fact_id", "rank", "sources", "memory_id", [1, 5, 10])


def blended_scores(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("scope is not null and mass is not null and confidence is not null and memory_id is not null")
    return m.select("memory_id", F.round(N.blended(m, "scope", "mass", "confidence", 0.3), 6).alias("score"))


def balanced_temperature(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("mass is not null and access_count is not null").select((4.0 * F.col("mass") - 2.0).alias("z"), (F.col("access_count") > 2).alias("y"))
    return N.balanced_temperature(m, "z", "y", [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5]).select("temperature", F.round("score", 6).alias("score"))


def prompt_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that a question about each fact would take, with its evidence as context."""
    f = read_table(spark, d, "fact_frames").where("evidence is not null and fact_id is not null").select("fact_id", "evidence", "subject").distinct()
    return N.token_estimate(f, F.concat(F.lit("Context: "), F.col("evidence"), F.lit(" Question: "), F.coalesce("subject", F.lit(""))), 64)


def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Fact values as predictions for what the facts of the same subject and predicate last said."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and fact_id is not null and asserted_at is not null and memory_id is not null and scope is not null and predicate is not null")
    f = f.groupBy("fact_id").agg(F.min(F.struct("recorded_at", "scope", "subject", "predicate", "object_value", "memory_id", "asserted_at", "polarity")).alias("x")).select("fact_id", "x.*")
    last = f.groupBy("scope", "subject", "predicate").agg(F.max(F.struct("asserted_at", "fact_id", "object_value", "memory_id", "polarity")).alias("l"))
    j = f.join(last, ["scope", "subject", "predicate"])
    cases = j.select(F.col("object_value").alias("prediction"), F.col("l.object_value").alias("answer"), (F.coalesce(F.col("l.polarity"), F.lit(1)) > 0).alias("answerable"), F.array("l.memory_id").alias("evidence"), F.array("memory_id").alias("hits"), F.array("l.memory_id").alias("citations"))
    return N.answer_report(cases)


QUERIES = {f.__name__: f for f in (capsule_recall_at_k, blended_scores, balanced_temperature, prompt_estimate, answer_quality)}

_UNIT = lambda c: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END"
_W = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"
_L = lambda x: f"CASE WHEN {_W(x)} = '' THEN [] ELSE string_split({_W(x)}, ' ') END"
SQL = {
    "blended_scores": f"SELECT memory_id, round(0.7e0 * ({_UNIT('mass')}) + 0.3e0 * ({_UNIT('confidence')}), 6) AS score FROM memories WHERE scope IS NOT NULL AND mass IS NOT NULL AND confidence IS NOT NULL AND memory_id IS NOT NULL WINDOW w AS (PARTITION BY scope)",
    "balanced_temperature": "WITH m AS (SELECT 4.0e0 * mass - 2.0e0 AS z, access_count > 2 AS y, unnest([0.25e0, 0.5e0, 0.75e0, 1.0e0, 1.5e0, 2.0e0, 2.5e0]) AS temperature FROM memories WHERE mass IS NOT NULL AND access_count IS NOT NULL), s AS (SELECT temperature, round(0.5e0 * avg(CASE WHEN y THEN (1 / (1 + exp(-z / temperature)) - 1) ** 2 END) + 0.5e0 * avg(CASE WHEN NOT y THEN (1 / (1 + exp(-z / temperature))) ** 2 END), 9) AS score FROM m GROUP BY temperature) SELECT temperature, round(score, 6) AS score FROM s ORDER BY s.score, temperature LIMIT 1",
    "prompt_estimate": "WITH f AS (SELECT DISTINCT fact_id, evidence, subject FROM fact_frames WHERE evidence IS NOT NULL AND fact_id IS NOT NULL), t AS (SELECT greatest(1, ceil(length('Context: ' || evidence || ' Question: ' || coalesce(subject, '')) / 4.0))::BIGINT AS t FROM f) SELECT count(*) AS questions, sum(t)::BIGINT AS input_tokens, count(*) * 64 AS output_tokens, quantile_cont(t, 0.5) AS p50, quantile_disc(t, 0.95) AS p95 FROM t",
    "answer_quality": f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at NULLS FIRST, scope, subject, predicate, object_value NULLS FIRST, memory_id, asserted_at, polarity NULLS FIRST) AS rn FROM fact_frames WHERE subject IS NOT NULL AND fact_id IS NOT NULL AND asserted_at IS NOT NULL AND memory_id IS NOT NULL AND scope IS NOT NULL AND predicate IS NOT NULL) WHERE rn = 1),
l AS (SELECT scope, subject, predicate, object_value AS answer, memory_id AS lm, coalesce(polarity, 1) > 0 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY scope, subject, predicate ORDER BY asserted_at DESC, fact_id DESC) AS n FROM f) WHERE n = 1),
j AS (SELECT object_value AS prediction, answer, ok, memory_id = lm AS found, {_L('object_value')} AS p, {_L('answer')} AS r FROM f JOIN l USING (scope, subject, predicate)),
k AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda y: y = w)), len(list_filter(r, lambda y: y = w))))), 0) AS same FROM j)
SELECT count(*) AS cases, round(avg(CASE WHEN ok THEN (array_to_string(p, ' ') = array_to_string(r, ' '))::INT ELSE 0 END), 6) AS exact, round(avg(CASE WHEN NOT ok THEN 0 WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE 2.0e0 * same / (len(p) + len(r)) END), 6) AS token_f1,
round(avg(found::INT), 6) AS evidence_recall, round(avg(found::INT), 6) AS grounded, round(avg(CASE WHEN NOT ok THEN (len(p) = 0 OR lower(trim(coalesce(prediction, ''))) IN ('unknown', 'i don''t know', '不知道', '无法回答'))::INT END), 6) AS abstention FROM k""",
}
