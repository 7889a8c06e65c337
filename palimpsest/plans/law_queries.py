"""Queries that rank memories by the laws of relevance, with their SQL.

The evidence of the facts whose id is divisible by 20 are the questions, all memories of their tenant the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import modes as M
from palimpsest.functions import text as T
from palimpsest.functions.encoders import hash_encoder
from palimpsest.functions.patterns import sql_says
from palimpsest.operators import capsules as K
from palimpsest.operators import laws as W
from palimpsest.operators import lexical as L
from palimpsest.operators import lifecycle as C
from palimpsest.operators import pairing as P
from palimpsest.operators import retrieval as R
from palimpsest.plans.retrieval_queries import _FAMILY, _JAC, NOW, _facts
from palimpsest.plans.source_queries import _RAW
from palimpsest.session import read_table


def _now():
    return F.lit(NOW).cast("timestamp")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every question with every memory of its tenant that shares a word with it."""
    m = read_table(spark, d, "memories").where("text is not null and updated_at is not null and memory_id is not null")
    m = m.select("tenant_id", "memory_id", "text", "mass", "confidence", "access_count", "kind", "created_at", "updated_at", F.array_distinct(T.memory_tokens("text")).alias("tok"), T.value_items("text").alias("items"))
    q = _facts(spark, d).select("fact_id", "tenant_id", "query", F.array_distinct(T.memory_tokens("query")).alias("q"), T.value_items("query").alias("qi"))
    words = m.select("tenant_id", "memory_id", F.explode("tok").alias("w"))
    hits = q.select("fact_id", "tenant_id", F.explode("q").alias("w")).join(words, ["tenant_id", "w"]).select("fact_id", "tenant_id", "memory_id").distinct()
    return hits.join(q, ["fact_id", "tenant_id"]).join(m, ["tenant_id", "memory_id"])


def _fields() -> dict:
    return {"semantic": T.jaccard(F.col("q"), F.col("tok")), "lexical": T.overlap_share(F.col("q"), F.col("tok")), "entity": T.overlap_share(F.col("qi"), F.col("items")), "trust": F.coalesce("confidence", F.lit(0.4))}


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("fact_id", "tenant_id", "query", F.array_distinct(T.memory_tokens("query")).alias("words"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("text is not null and updated_at is not null")
    return m.withColumns({"words": F.array_distinct(T.memory_tokens("text")), "trust": F.coalesce("confidence", F.lit(0.4)), "age": C.age_days(_now(), F.col("updated_at"))})


def planetary_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The five memories of the greatest planetary force for each question, with radius and energy of their orbit."""
    query = F.col("query")
    weights = {f"w_{k}": v for k, v in M.signal_weights(query).items() if k not in ("graph", "neural")}
    q = _asked(spark, d).select(
        "fact_id", "tenant_id", "words", T.value_items("query").alias("items"), C.numbers_of("query").alias("numbers"), W.negated("query").alias("negated"),
        M.matches(query, "time_words").alias("about_time"), *[v.alias(k) for k, v in weights.items()],
    )
    m = _told(spark, d).select(
        "memory_id", "tenant_id", "words", T.value_items("text").alias("items"), C.numbers_of("text").alias("numbers"), W.negated("text").alias("negated"), "trust",
        F.exp(-F.col("age") / 365.0).alias("slow_age"), F.exp(-F.col("age") / 120.0).alias("fast_age"), F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 10.0).alias("utility"),
        F.coalesce(F.col("mass") >= 0.5, F.lit(False)).alias("stable"),
    )
    best = P.best_by_law(q, m, "tenant_id", "fact_id", "memory_id", ["words", "items", "numbers"], W.planetary_pairs, "force", 5)
    m = read_table(spark, d, "memories").select("memory_id", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    o = W.orbit_of(F.col("force"), F.col("mass"))
    return best.join(m, "memory_id").select("fact_id", "memory_id", "force", "rank", P.rounded_column(o["radius"], 5).alias("radius"), P.rounded_column(o["energy"], 5).alias("energy"))


def cognitive_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The five memories of the greatest cognitive force for each question; directives resonate where the question needs them."""
    role = (R.directive_role("text", F.lower(F.trim("kind"))).isNotNull()).cast("double")
    m = _told(spark, d).withColumn("role", role)
    m = m.select("memory_id", "tenant_id", "words", "role", F.exp(-F.col("age") / F.when(F.col("role") > 0, 365.0).otherwise(150.0)).alias("recency"), "trust")
    return P.best_by_law(_asked(spark, d).drop("query"), m, "tenant_id", "fact_id", "memory_id", ["words"], W.cognitive_pairs, "force", 5)


def gravity_capture(spark: SparkSession, d: str) -> DataFrame:
    """Memories that a question captures (0.54 or more), the best 32 each."""
    j, f = _pairs(spark, d), _fields()
    fields = {"semantic": f["semantic"], "lexical": f["lexical"], "entity": f["entity"], "trust": f["trust"], "vitality": W.vitality(F.lit(0.5), f["trust"]), "mass": W.bounded_mass(F.coalesce("mass", F.lit(0.0)))}
    g = W.gravity(fields, F.lit(0.0), F.lit(0.0))
    best = L.top_k(j.withColumn("capture", g["capture"]), "fact_id", "memory_id", "capture", 32)
    return best.where("capture >= 0.54").select("fact_id", "memory_id", "capture", "rank")


def directive_bonus(spark: SparkSession, d: str) -> DataFrame:
    """Bonus of each directive among the writes for three questions, where it applies."""
    w = read_table(spark, d, "memory_writes").where("text is not null and write_id is not null")
    w = w.select("write_id", "text", R.directive_role("text", F.lower(F.trim("kind"))).alias("role"), R.directive_family("text").alias("family")).where("role is not null").distinct()
    x = w.withColumn("question", F.explode(F.array(*[F.lit(q) for q in _QUESTIONS])))
    b = W.directive_gravity(F.col("question"), F.col("text"), F.col("role"), F.col("family"))
    return x.withColumn("bonus", F.round(b, 6)).where("bonus > 0").groupBy("write_id", "question").agg(F.max("bonus").alias("bonus"))


_QUESTIONS = ["How should I implement the check of the budget?", "Which tool would I prefer for the review?", "When did I change the plan?"]


def capsule_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The three best capsules of each question's home scope: best member by words and entities, mean trust, span of months."""
    m = read_table(spark, d, "memories").where("scope is not null and text is not null and created_at is not null and updated_at is not null and memory_id is not null")
    caps = K.window_capsules(m.select("scope", "memory_id"), ["scope"], ["memory_id"], "memory_id")
    parts = m.select("memory_id", F.array_distinct(T.memory_tokens("text")).alias("tok"), T.value_items("text").alias("items"), F.coalesce("confidence", F.lit(0.4)).alias("trust"), F.date_format("created_at", "yyyy-MM").alias("month"), C.age_days(_now(), F.col("updated_at")).alias("age"))
    q = _facts(spark, d).join(m.select(F.col("memory_id").alias("home"), "scope"), "home").select("fact_id", "scope", F.array_distinct(T.memory_tokens("query")).alias("q"), T.value_items("query").alias("qi"), M.query_modes(F.col("query"))["episodic"].alias("episodic"))
    j = q.join(caps, "scope").select("fact_id", "q", "qi", "episodic", "sources", F.explode("sources").alias("memory_id")).join(parts, "memory_id")
    g = j.groupBy("fact_id", "sources").agg(
        F.max(T.jaccard(F.col("q"), F.col("tok"))).alias("semantic"), F.max(T.overlap_share(F.col("q"), F.col("tok"))).alias("lexical"), F.max(T.overlap_share(F.col("qi"), F.col("items"))).alias("entity"),
        F.avg("trust").alias("trust"), W.capsule_time(F.bool_or("episodic"), F.countDistinct("month"), F.min("age")).alias("temporal"),
    )
    r = g.select("fact_id", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("capsule"), W.capsule_relevance({k: F.col(k) for k in ("semantic", "lexical", "entity", "trust", "temporal")}).alias("relevance"))
    return L.top_k(r, "fact_id", "capsule", "relevance", 3)


def cold_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The best ten archived memories for each question, with invalidated ones where it is about the past."""
    r = read_table(spark, d, "memory_records").where("snapshot_at is not null and memory_id is not null")
    last = r.groupBy("memory_id").agg(F.max(F.struct("snapshot_at", "loaded_at", F.lower(F.trim("state")).alias("state"), "active")).alias("x")).select("memory_id", "x.state", "x.active")
    j, f = _pairs(spark, d).join(last.select("memory_id", "state"), "memory_id"), _fields()
    hot = last.where("active = 1 and state in ('stable', 'provisional')").select("memory_id")
    return R.cold_candidates(j, "fact_id", "memory_id", f["lexical"], f["entity"], F.coalesce("state", F.lit("")), M.matches(F.col("query"), "historical"), hot, 10)


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Entity mentions that are another spelling of an earlier one of their scope, by names, kinds and hashed vectors."""
    e = read_table(spark, d, "entity_items").where("scope is not null and name is not null and item_id is not null").groupBy("scope", "name").agg(F.min("item_id").alias("item_id"), F.min(F.lower(F.trim("entity_type"))).alias("kind"))
    merged, _ = R.identity_matches(e.withColumn("v", hash_encoder(128)(F.col("name"))), "scope", "item_id", "name", "kind", "v")
    return merged


QUERIES = {f.__name__: f for f in (planetary_retrieval, cognitive_retrieval, gravity_capture, directive_bonus, capsule_relevance, cold_retrieval, identities)}

_TOK, _ITEMS = T.sql_memory_tokens, T.sql_value_items
_NUM = "list_distinct(regexp_extract_all({x}, '[0-9]+(?:[.][0-9]+)?'))"
_AGE = f"greatest(0.0e0, (epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(updated_at)) / 86400000000.0e0)"
_NEGATED = lambda x: "(" + " OR ".join(f"contains({x}, '{n}')" for n in (*T.NEGATIONS, "从未")) + ")"
_SHARE = lambda q, t: f"(len(list_intersect({q}, {t})) / greatest(1, len({q}))::DOUBLE)"
_Q = "q AS (SELECT fact_id, tenant_id, memory_id AS home, evidence AS query FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at NULLS FIRST, memory_id, evidence, tenant_id NULLS FIRST) AS rn FROM fact_frames WHERE evidence IS NOT NULL AND memory_id IS NOT NULL AND fact_id % 20 = 0) WHERE rn = 1)"
_J = f"""{_Q}, qq AS (SELECT fact_id, tenant_id, query, list_distinct({_TOK('query')}) AS q, {_ITEMS('query')} AS qi FROM q), m AS (SELECT tenant_id, memory_id, text, coalesce(mass, 0) AS mass, mass >= 0.5 AS stable, coalesce(confidence, 0.4e0) AS trust, coalesce(access_count, 0) AS uses, kind, updated_at, list_distinct({_TOK('text')}) AS tok, {_ITEMS('text')} AS items FROM memories WHERE text IS NOT NULL AND updated_at IS NOT NULL AND memory_id IS NOT NULL),
j AS (SELECT *, {_JAC.format(a='q', b='tok')} AS semantic, {_SHARE('q', 'tok')} AS lexical, {_SHARE('qi', 'items')} AS entity FROM qq JOIN m USING (tenant_id) WHERE list_has_any(q, tok))"""
_TOTAL = "(" + " + ".join(f"({v})" for v in _RAW.values()) + ")"
_w = lambda k: f"(({_RAW[k]}) / {_TOTAL})"
_TOP = lambda score, k: f"SELECT fact_id, memory_id, {score}, rank FROM (SELECT fact_id, memory_id, round({score}, 6) AS {score}, row_number() OVER (PARTITION BY fact_id ORDER BY round({score}, 6) DESC, memory_id)::INT AS rank FROM s) WHERE rank <= {k}"
_ROLE = f"(CASE WHEN lower(trim(kind)) IN ('instruction', 'preference') OR {sql_says('text', R.PREFERENCE)} OR {sql_says('text', R.INSTRUCTION)} THEN 1.0e0 ELSE 0.0e0 END)"
_CONTENT = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_.:/-]+|[㐀-鿿]+'), lambda w: lower(w)), lambda w: w NOT IN ({', '.join(repr(w) for w in W.DIRECTIVE_STOP)})))"
_MATCH = "CASE family " + " ".join(f"WHEN '{k}' THEN regexp_matches(lower(question), '{'|'.join(v)}')" for k, v in W.FAMILY_CUES.items()) + " ELSE false END"
_mq = lambda n: M.sql_matches("question", n)
SQL = {
    "planetary_retrieval": f"""WITH {_J}, f AS (SELECT *, {_w('semantic')} * semantic + {_w('bm25')} * lexical + {_w('entity')} * entity + {_w('temporal')} * exp(-{_AGE} / CASE WHEN {M.sql_matches('query', 'time_words')} THEN 365.0e0 ELSE 120.0e0 END) + {_w('authority')} * trust + {_w('utility')} * least(1.0e0, uses / 10.0e0) AS pull,
least(1.0e0, 0.65e0 * ({_NEGATED(f"array_to_string({_TOK('query')}, ' ')")} <> {_NEGATED(f"array_to_string({_TOK('text')}, ' ')")})::INT + 0.55e0 * (len({_NUM.format(x='query')}) > 0 AND len({_NUM.format(x='text')}) > 0 AND NOT list_has_any({_NUM.format(x='query')}, {_NUM.format(x='text')}))::INT) AS c FROM j),
s AS (SELECT fact_id, memory_id, greatest(0.0e0, CASE WHEN stable THEN 1.0e0 ELSE 0.78e0 END * (pull - 0.20e0 * c)) AS force FROM f), t AS ({_TOP('force', 5)})
SELECT fact_id, memory_id, force, rank, round(1.0e0 / (0.05e0 + force), 5) AS radius, round(0.0e0 - coalesce(mass, 0) * force, 5) AS energy FROM t JOIN memories USING (memory_id)""",
    "cognitive_retrieval": f"WITH {_J}, s AS (SELECT fact_id, memory_id, greatest(0.0e0, least(1.25e0, 0.30e0 * semantic + 0.18e0 * lexical + 0.24e0 * {_ROLE} + 0.08e0 * exp(-{_AGE} / CASE WHEN {_ROLE} > 0 THEN 365.0e0 ELSE 150.0e0 END) + 0.08e0 * trust)) AS force FROM j) {_TOP('force', 5)}",
    "gravity_capture": f"WITH {_J}, n AS (SELECT *, 0.30e0 * semantic + 0.14e0 * lexical + 0.15e0 * entity + 0.08e0 * greatest(0.0e0, least(1.0e0, trust)) + 0.05e0 * greatest(0.0e0, least(1.0e0, 0.3e0 + 0.4e0 * trust)) + 0.03e0 * (2.0e0 / (1.0e0 + exp(-2.0e0 * ln(1.0e0 + greatest(0.0e0, mass)) / 3.0e0)) - 1.0e0) - 0.07e0 * (1.0e0 - greatest(0.0e0, least(1.0e0, trust))) AS net FROM j), s AS (SELECT fact_id, memory_id, 1.0e0 / (1.0e0 + exp(-net / 0.16e0)) AS capture FROM n) SELECT * FROM ({_TOP('capture', 32)}) WHERE capture >= 0.54",
    "directive_bonus": f"""WITH w AS (SELECT DISTINCT write_id, text, CASE WHEN lower(trim(kind)) IN ('instruction', 'preference') THEN lower(trim(kind)) WHEN {sql_says('text', R.PREFERENCE)} THEN 'preference' WHEN {sql_says('text', R.INSTRUCTION)} THEN 'instruction' END AS role, {_FAMILY} AS family FROM memory_writes WHERE text IS NOT NULL AND write_id IS NOT NULL),
x AS (SELECT *, unnest([{', '.join(repr(q) for q in _QUESTIONS)}]) AS question FROM w WHERE role IS NOT NULL), y AS (SELECT *, {_MATCH} AS hit, len(list_intersect({_CONTENT('question')}, {_CONTENT('text')})) / greatest(1, len({_CONTENT('question')}))::DOUBLE AS lex FROM x),
z AS (SELECT *, 0.24e0 + 0.14e0 * least(1.0e0, greatest(CASE role WHEN 'instruction' THEN 0.45e0 ELSE 0.30e0 END, 0.58e0 * lex + 0.42e0 * hit::INT)) AS b FROM y WHERE ((role = 'instruction' AND ({_mq('task')} OR {_mq('contradiction')})) OR (role = 'preference' AND ({_mq('preference')} OR {_mq('task')} OR {_mq('contradiction')}) AND {sql_says('question', W.USUAL)})) AND NOT {sql_says('question', W.LOOKUP)} AND NOT {sql_says('question', W.MANY_SOURCES)} AND (hit OR lex >= 0.15))
SELECT write_id, question, max(round(b, 6)) AS bonus FROM z GROUP BY ALL""",
    "cold_retrieval": f"""WITH {_J}, l AS (SELECT memory_id, state, active FROM (SELECT memory_id, lower(trim(state)) AS state, active, row_number() OVER (PARTITION BY memory_id ORDER BY snapshot_at DESC, loaded_at DESC NULLS LAST, lower(trim(state)) DESC NULLS LAST, active DESC NULLS LAST) AS rn FROM memory_records WHERE snapshot_at IS NOT NULL AND memory_id IS NOT NULL) WHERE rn = 1),
c AS (SELECT fact_id, memory_id, lexical, entity, state, {M.sql_matches('query', 'historical')} AS past FROM j JOIN l USING (memory_id) WHERE memory_id NOT IN (SELECT memory_id FROM l WHERE active = 1 AND state IN ('stable', 'provisional'))),
s AS (SELECT fact_id, memory_id, round(0.62e0 * lexical + 0.28e0 * entity + 0.10e0 * (past AND state = 'invalidated')::INT, 6) AS score FROM c WHERE state = 'archived' OR (state = 'invalidated' AND past)) SELECT fact_id, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, memory_id) AS rn FROM s) WHERE rn <= 10""",
}
