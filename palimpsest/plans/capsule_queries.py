"""Queries of evidence groups and bounded selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import capsules as P
from palimpsest.operators import selection as S
from palimpsest.session import read_table


def _mem(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("scope is not null and text is not null and mass is not null")
    return m.select("tenant_id", "scope", "memory_id", "text", "mass", F.coalesce("access_count", F.lit(0)).alias("uses"), "updated_at")


def _ranked(df: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy("scope").orderBy(F.col(by).desc(), "memory_id")
    return df.withColumn("rank", F.row_number().over(w))


def capsule_windows(spark: SparkSession, d: str) -> DataFrame:
    c = P.window_capsules(_mem(spark, d), ["scope"], ["memory_id"], "memory_id")
    return c.select("scope", F.array_join("sources", ",").alias("sources"), P.capsule_id(F.lit("window"), F.col("sources")).alias("capsule_id"))


def entity_capsules(spark: SparkSession, d: str) -> DataFrame:
    c = P.entity_capsules(_mem(spark, d), "memory_id", T.text_entities("text"), ["tenant_id"])
    return c.select("tenant_id", "entity", F.array_join("sources", ",").alias("sources"))


def version_chains(spark: SparkSession, d: str) -> DataFrame:
    """The last four facts of each subject and predicate, oldest first."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and asserted_at is not null").select("tenant_id", "scope", "subject", "predicate", "fact_id", "asserted_at").distinct()
    keys = ["tenant_id", "scope", "subject", "predicate"]
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("asserted_at").desc(), F.col("fact_id").desc()))).where("rn <= 4")
    g = f.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("asserted_at", "fact_id"))).alias("x"))
    return g.where(F.size("x") >= 2).select(*keys, F.array_join(F.transform("x", lambda x: x["fact_id"].cast("string")), ",").alias("chain"))


def satellite_stripes(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(_mem(spark, d), "mass").where("rank > 3 and rank <= 13").withColumn("sat", F.col("rank") - 3)
    return P.stripe(r, "scope", "memory_id", "sat", 3).select("scope", F.col("slot").cast("int").alias("slot"), F.array_join("extra", ",").alias("extra"))


def protected_union(spark: SparkSession, d: str) -> DataFrame:
    """The four heaviest memories of a scope keep their order; the most used follow."""
    m = _mem(spark, d)
    u = P.ordered_union([_ranked(m, "mass").where("rank <= 4"), _ranked(m, "uses")], ["scope", "memory_id"], "rank")
    w = Window.partitionBy("scope").orderBy("_p")
    return u.select("scope", "memory_id", F.row_number().over(w).alias("place"))


def interleaved_lists(spark: SparkSession, d: str) -> DataFrame:
    m = _mem(spark, d)
    return P.round_robin([_ranked(m, "mass"), _ranked(m, "uses")], "scope", "memory_id", "rank", 12)


def neighbour_expansion(spark: SparkSession, d: str) -> DataFrame:
    m = _mem(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("scope").orderBy("memory_id")))
    seeds = m.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("mass").desc(), "ord"))).where("rank <= 3")
    return P.neighbour_order(seeds, m, "scope", "ord", "rank")


def answer_audit_split(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each group for the audit, and those among them that are not said to be over for the answer."""
    m = _mem(spark, d).withColumn("gone", P.says_negative("text"))
    c = P.window_capsules(m, ["scope"], ["memory_id"], "memory_id").withColumn("audit", F.array_join("sources", ","))
    parts = c.select("scope", "audit", F.explode("sources").alias("memory_id")).join(m.select("memory_id", "gone"), "memory_id")
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.col("memory_id"))))
    return parts.groupBy("scope", "audit").agg(F.array_join(kept, ",").alias("answer"))


def state_adjustment(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").where("text is not null").select("memory_id", P.state_adjustment("text").cast("double").alias("delta"))


def fact_atoms(spark: SparkSession, d: str) -> DataFrame:
    a = P.fact_atoms(read_table(spark, d, "memories").where("text is not null"), "memory_id", "text")
    return a.select("memory_id", "atom", F.array_join("tokens", " ").alias("tokens"), F.array_join("numbers", " ").alias("numbers"), "state")


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of 50 memories of the largest tenant after a cursor, newest first."""
    m = read_table(spark, d, "memories").where("updated_at is not null and tenant_id = 't-0000'").select("memory_id", "updated_at")
    at = F.lit("2025-10-01").cast("timestamp")
    page = m.where((F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("memory_id") < 1000)))
    return page.orderBy(F.col("updated_at").desc(), F.col("memory_id").desc()).limit(50).select("memory_id", F.unix_seconds("updated_at").alias("updated_s"))


def capture_threshold(spark: SparkSession, d: str) -> DataFrame:
    return S.mad_threshold(_mem(spark, d), "scope", "mass").select("scope", F.round("threshold", 8).alias("threshold"))


def softmax_activation(spark: SparkSession, d: str) -> DataFrame:
    a = S.softmax_activation(_mem(spark, d), "tenant_id", "memory_id", "mass")
    return a.select("tenant_id", "memory_id", F.round("activation", 6).alias("activation"))


def entropy_budget(spark: SparkSession, d: str) -> DataFrame:
    return S.entropy_budget(_ranked(_mem(spark, d), "mass"), "scope", "mass", "rank")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Heaviest memories of each scope while their texts fit 1,200 characters."""
    r = S.running_budget(_mem(spark, d), "scope", [F.col("mass").desc(), F.col("memory_id")], F.length("text"), 1200)
    return r.select("scope", "memory_id")


def _tokened(spark: SparkSession, d: str) -> DataFrame:
    return _mem(spark, d).withColumn("tokens", F.array_distinct(T.memory_tokens("text"))).withColumn("chars", F.length("text")).withColumn("session", F.date_format("updated_at", "yyyy-MM"))


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return S.mmr(_tokened(spark, d), "scope", "memory_id", "mass", "tokens", size="chars", budget=6000)


def coverage_greedy(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage(_tokened(spark, d), "scope", "memory_id", "mass", "tokens", "session")


def knapsack_context(spark: SparkSession, d: str) -> DataFrame:
    return S.knapsack(_tokened(spark, d), "scope", "memory_id", "mass", "chars", 1200)


def beam_bridge(spark: SparkSession, d: str) -> DataFrame:
    return S.beam_bridge(_tokened(spark, d), "scope", "memory_id", "mass", "tokens")


QUERIES = {
    f.__name__: f
    for f in (
        capsule_windows, entity_capsules, version_chains, satellite_stripes, protected_union, interleaved_lists, neighbour_expansion, answer_audit_split, state_adjustment, fact_atoms,
        keyset_page, capture_threshold, softmax_activation, entropy_budget, context_budget, mmr_select, coverage_greedy, knapsack_context, beam_bridge,
    )
}

_M = "m AS (SELECT tenant_id, scope, memory_id, text, mass, coalesce(access_count, 0) AS uses, updated_at FROM memories WHERE scope IS NOT NULL AND text IS NOT NULL AND mass IS NOT NULL)"
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY mass DESC, memory_id) AS rank FROM m)"
_U = "u AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY uses DESC, memory_id) AS rank FROM m)"
_WIN = """w AS (SELECT scope, row_number() OVER x - 1 AS rn, list(memory_id) OVER (PARTITION BY scope ORDER BY memory_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM m WINDOW x AS (PARTITION BY scope ORDER BY memory_id)),
c AS (SELECT DISTINCT scope, s FROM (SELECT scope, l[1:2] AS s FROM w WHERE len(l) >= 2 UNION ALL SELECT scope, l FROM w WHERE len(l) >= 2 AND rn % 3 = 0))"""


def _sql_says(x: str, words: list[str], phrases: list[str]) -> str:
    return "(" + " OR ".join([f"list_has_any(string_split_regex(lower({x}), '[^a-z]+'), [{', '.join(repr(w) for w in words)}])", *[f"contains(lower({x}), '{p}')" for p in phrases]]) + ")"


def _neg(x: str) -> str:
    return _sql_says(x, P.NEGATIVE_STATE, P.NEGATIVE_PHRASES)


def _pos(x: str) -> str:
    return _sql_says(x, P.POSITIVE_STATE, P.POSITIVE_PHRASES)


_JOIN = "list_reduce(list_transform({x}, lambda v: v::VARCHAR), lambda a, b: a || ',' || b)"
SQL = {
    "capsule_windows": f"WITH {_M}, {_WIN}, j AS (SELECT scope, array_to_string(s, ',') AS sources FROM c) SELECT scope, sources, 'cap_' || substr(sha256('window|' || sources), 1, 20) AS capsule_id FROM j",
    "entity_capsules": f"WITH {_M}, e AS (SELECT DISTINCT tenant_id, memory_id, unnest({T.sql_text_entities('text')}) AS entity FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, entity) AS n FROM e), w AS (SELECT tenant_id, entity, row_number() OVER (PARTITION BY tenant_id, entity ORDER BY memory_id) - 1 AS rn, list(memory_id) OVER (PARTITION BY tenant_id, entity ORDER BY memory_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM n WHERE n BETWEEN 2 AND 64) SELECT tenant_id, entity, array_to_string(l, ',') AS sources FROM w WHERE rn % 3 = 0 AND len(l) >= 2",
    "version_chains": "WITH f AS (SELECT DISTINCT tenant_id, scope, subject, predicate, fact_id, asserted_at FROM fact_frames WHERE subject IS NOT NULL AND asserted_at IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, scope, subject, predicate ORDER BY asserted_at DESC, fact_id DESC) AS rn FROM f) SELECT tenant_id, scope, subject, predicate, string_agg(fact_id::VARCHAR, ',' ORDER BY asserted_at, fact_id) AS chain FROM r WHERE rn <= 4 GROUP BY ALL HAVING count(*) >= 2",
    "satellite_stripes": f"WITH {_M}, {_R} SELECT scope, ((rank - 4) % 3)::INT AS slot, string_agg(memory_id::VARCHAR, ',' ORDER BY rank) AS extra FROM r WHERE rank > 3 AND rank <= 13 GROUP BY ALL",
    "protected_union": f"WITH {_M}, {_R}, {_U}, a AS (SELECT scope, memory_id, 0 AS l, rank FROM r WHERE rank <= 4 UNION ALL SELECT scope, memory_id, 1, rank FROM u), b AS (SELECT scope, memory_id, min(l * 1000000 + rank) AS k FROM a GROUP BY ALL) SELECT scope, memory_id, row_number() OVER (PARTITION BY scope ORDER BY k)::INT AS place FROM b",
    "interleaved_lists": f"WITH {_M}, {_R}, {_U}, a AS (SELECT scope, memory_id, rank * 2 AS k FROM r UNION ALL SELECT scope, memory_id, rank * 2 + 1 FROM u), b AS (SELECT scope, memory_id, min(k) AS k FROM a GROUP BY ALL) SELECT * FROM (SELECT scope, memory_id, row_number() OVER (PARTITION BY scope ORDER BY k, memory_id)::INT AS place FROM b) WHERE place <= 12",
    "neighbour_expansion": f"WITH {_M}, o AS (SELECT scope, mass, row_number() OVER (PARTITION BY scope ORDER BY memory_id)::INT AS ord FROM m), s AS (SELECT scope, ord, row_number() OVER (PARTITION BY scope ORDER BY mass DESC, ord) AS rank FROM o), n AS (SELECT scope, ord, min(k) AS k FROM (SELECT scope, ord, rank * 3 AS k FROM s WHERE rank <= 3 UNION ALL SELECT scope, ord - 1, rank * 3 + 1 FROM s WHERE rank <= 3 UNION ALL SELECT scope, ord + 1, rank * 3 + 2 FROM s WHERE rank <= 3) GROUP BY ALL) SELECT scope, ord, row_number() OVER (PARTITION BY scope ORDER BY k NULLS LAST, ord)::INT AS place FROM o LEFT JOIN n USING (scope, ord)",
    "answer_audit_split": f"WITH {_M}, {_WIN}, p AS (SELECT scope, array_to_string(s, ',') AS audit, unnest(s) AS memory_id FROM c) SELECT p.scope, audit, coalesce(string_agg(CASE WHEN NOT {_neg('text')} THEN memory_id::VARCHAR END, ',' ORDER BY memory_id), '') AS answer FROM p JOIN m USING (memory_id) GROUP BY ALL",
    "state_adjustment": f"SELECT memory_id, CASE WHEN {_neg('text')} AND NOT {_pos('text')} THEN -0.18e0 WHEN {_pos('text')} AND NOT {_neg('text')} THEN 0.08e0 WHEN {_neg('text')} THEN -0.04e0 ELSE 0.0e0 END AS delta FROM memories WHERE text IS NOT NULL",
    "fact_atoms": f"WITH s AS (SELECT memory_id, string_split_regex(text, '[.!?;\\n]+|\\s+(?:but|however|although|while)\\s+') AS l FROM memories WHERE text IS NOT NULL), x AS (SELECT memory_id, unnest(l) AS clause, generate_subscripts(l, 1) - 1 AS atom FROM s), y AS (SELECT memory_id, atom::INT AS atom, clause, {T.sql_content_words('clause')} AS w, regexp_extract_all(clause, '[0-9]+(?:[.,:][0-9]+)*') AS n FROM x), z AS (SELECT *, list_filter(w, lambda v, i: list_position(w, v) = i) AS wd, list_filter(n, lambda v, i: list_position(n, v) = i) AS nd FROM y) SELECT memory_id, atom, array_to_string(wd, ' ') AS tokens, array_to_string(nd, ' ') AS numbers, CASE WHEN {_neg('clause')} AND NOT {_pos('clause')} THEN -1 WHEN {_pos('clause')} AND NOT {_neg('clause')} THEN 1 ELSE 0 END AS state FROM z WHERE len(w) > 0 OR len(n) > 0",
    "keyset_page": "SELECT memory_id, CAST(epoch(updated_at) AS BIGINT) AS updated_s FROM memories WHERE tenant_id = 't-0000' AND (updated_at < TIMESTAMPTZ '2025-10-01 00:00:00+00' OR (updated_at = TIMESTAMPTZ '2025-10-01 00:00:00+00' AND memory_id < 1000)) ORDER BY updated_at DESC, memory_id DESC LIMIT 50",
    "capture_threshold": f"WITH {_M}, a AS (SELECT scope, median(mass) AS md FROM m GROUP BY scope) SELECT scope, round(greatest(0.015e0, any_value(md) + 0.35e0 * median(abs(mass - md))), 8) AS threshold FROM m JOIN a USING (scope) GROUP BY scope",
    "softmax_activation": f"WITH {_M}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY mass DESC, memory_id) AS rn FROM m) WHERE rn <= 64), e AS (SELECT *, exp(mass - max(mass) OVER (PARTITION BY tenant_id)) AS e FROM k) SELECT tenant_id, memory_id, round(e / sum(e) OVER (PARTITION BY tenant_id) * 12.0e0, 6) AS activation FROM e",
    "entropy_budget": f"WITH {_M}, {_R}, e AS (SELECT scope, rank, exp((mass - max(mass) OVER (PARTITION BY scope)) / 0.08e0) AS e, count(*) OVER (PARTITION BY scope) AS n FROM r WHERE rank <= 8), s AS (SELECT *, sum(e) OVER (PARTITION BY scope ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY scope) AS sh FROM e) SELECT scope, coalesce(min(CASE WHEN rank >= least(4, n) AND round(sh, 9) >= 0.7 THEN rank END), max(n))::BIGINT AS budget FROM s GROUP BY scope",
    "context_budget": f"WITH {_M}, u AS (SELECT scope, memory_id, length(text) AS c, sum(length(text)) OVER (PARTITION BY scope ORDER BY mass DESC, memory_id ROWS UNBOUNDED PRECEDING) AS used FROM m) SELECT scope, memory_id FROM u WHERE used <= 1200 OR used = c",
}
