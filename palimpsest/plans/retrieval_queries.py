"""Queries of hybrid retrieval, directives, episodes, grounding, statement graphs and encryption, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import graph as G
from palimpsest.operators import lexical as L
from palimpsest.operators import lifecycle as C
from palimpsest.operators import retrieval as R
from palimpsest.functions.patterns import sql_says
from palimpsest.session import read_table

NOW = "2026-03-01 00:00:00"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "fact_frames").where("evidence is not null and memory_id is not null and fact_id % 20 = 0")
    first = f.groupBy("fact_id").agg(F.min(F.struct("recorded_at", "memory_id", "evidence", "tenant_id")).alias("x"))
    return first.select("fact_id", F.col("x.memory_id").alias("home"), F.col("x.evidence").alias("query"), F.col("x.tenant_id").alias("tenant_id"))


def hybrid_force(spark: SparkSession, d: str) -> DataFrame:
    """Best five memories of its tenant for each fact whose id is divisible by 20: overlap, entities, mass, recency and use fused."""
    now = F.lit(NOW).cast("timestamp")
    m = read_table(spark, d, "memories").where("text is not null and updated_at is not null").select("tenant_id", "memory_id", F.array_distinct(T.memory_tokens("text")).alias("tok"), T.value_items("text").alias("items"), "mass", "updated_at")
    q = _facts(spark, d).select("fact_id", "tenant_id", F.array_distinct(T.memory_tokens("query")).alias("q"), T.value_items("query").alias("qi"))
    words = m.select("tenant_id", "memory_id", F.explode("tok").alias("w"))
    hits = q.select("fact_id", "tenant_id", F.explode("q").alias("w")).join(words, ["tenant_id", "w"]).select("fact_id", "tenant_id", "memory_id").distinct()
    j = hits.join(q, ["fact_id", "tenant_id"]).join(m, ["tenant_id", "memory_id"])
    score = R.force({
        "semantic": T.jaccard(F.col("q"), F.col("tok")), "lexical": T.overlap_share(F.col("q"), F.col("tok")), "entity": T.overlap_share(F.col("qi"), F.col("items")),
        "temporal": F.exp(-C.age_days(now, F.col("updated_at")) / 365.0), "graph": F.col("mass"),
    })
    return L.top_k(j.withColumn("score", score), "fact_id", "memory_id", "score", 5)


def directive_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last two directives of each scope, role and family."""
    w = read_table(spark, d, "memory_writes").where("text is not null and scope is not null and written_at is not null")
    w = w.select("write_id", "scope", "written_at", R.directive_role("text", F.lower(F.trim("kind"))).alias("role"), R.directive_family("text").alias("family")).where("role is not null").distinct()
    return R.latest_per_family(w, ["scope", "role", "family"], [F.col("written_at").desc(), F.col("write_id").desc()], 2).select("scope", "role", "family", "write_id", "place")


def episode_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Memories at most two places in time away from the three heaviest of their scope."""
    m = read_table(spark, d, "memories").where("scope is not null and mass is not null and created_at is not null")
    m = m.withColumn("ord", F.row_number().over(Window.partitionBy("scope").orderBy("created_at", "memory_id"))).select("scope", "memory_id", "mass", "ord")
    top = m.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("mass").desc(), "memory_id"))).where("r <= 3")
    return R.around(top, m, "scope", "ord", 2).select("scope", "memory_id", "ord")


def grounded_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose value is found in their evidence, with a safe predicate and bounded confidence; others are dropped."""
    f = read_table(spark, d, "fact_frames").where("fact_id is not null")
    ok = f.where(R.grounded(F.col("evidence"), F.col("object_value")))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return ok.select("fact_id", R.predicate_slug(F.col("predicate")).alias("predicate"), F.round(conf, 6).alias("confidence"), F.when(F.col("polarity") < 0, -1).otherwise(1).alias("polarity")).distinct()


def statement_closure(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to three current facts: the object of one is the subject of the next, within a scope."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and object_value is not null and scope is not null and asserted_at is not null and predicate is not null")
    r = read_table(spark, d, "entity_relations").where("subject is not null and object_value is not null and scope is not null and valid_from is not null and predicate is not null")
    rows = f.select("scope", "subject", "predicate", "object_value", F.col("asserted_at").alias("at"), F.col("fact_id").alias("id")).unionByName(
        r.select("scope", "subject", "predicate", "object_value", F.col("valid_from").alias("at"), F.col("relation_id").alias("id"))
    )
    now = G.current_edges(rows, ["scope", "subject", "predicate"], "object_value", ["at", "id", "object_value"])
    e = now.groupBy("scope", "subject", "object_value").agg(F.lit(1.0).alias("w")).where("subject <> object_value")
    starts = e.select("scope", F.col("subject").alias("start")).distinct()
    p = G.best_paths(e, starts, "scope", "subject", "object_value", "w", 3, 0.8, 48)
    return p.where("hop > 1").select("scope", "start", "node", "hop", F.array_join("path", " > ").alias("path"))


def chunk_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of document windows (1,200 every 1,000) and blocks (700 every 700) that share characters."""
    docs = read_table(spark, d, "documents").where("text is not null and length(text) > 0").select("doc_id", F.length("text").alias("n"))
    cut = lambda step, size: docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("start")).select("doc_id", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))
    o = R.overlap_join(cut(1000, 1200), cut(700, 700), ["doc_id"], 1000)
    return o.select("doc_id", "start", "r_start", (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))


def consolidation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Memories of one scope with a token overlap of 0.8 or more and no conflict: which one is kept."""
    m = read_table(spark, d, "memories").where("text is not null and scope is not null and mass is not null").select("scope", "memory_id", "mass", "text", F.array_distinct(T.memory_tokens("text")).alias("tok"))
    p = G.similar_sets(m, "scope", "tok", 0.8, "a", "b")
    p = p.where("a.memory_id < b.memory_id").where(~C.conflict("a.text", "b.text"))
    first = F.col("a.mass") >= F.col("b.mass")
    return p.select("scope", F.when(first, F.col("a.memory_id")).otherwise(F.col("b.memory_id")).alias("kept"), F.when(first, F.col("b.memory_id")).otherwise(F.col("a.memory_id")).alias("merged"))


def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts sealed with AES-GCM under a key per tenant and opened again: rows and characters per tenant."""
    m = read_table(spark, d, "memories").where("text is not null and tenant_id is not null").select("tenant_id", "text")
    key = F.unhex(F.sha2(F.concat(F.lit("master|"), "tenant_id"), 256))
    sealed = m.select("tenant_id", F.aes_encrypt(F.col("text"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.col("tenant_id")).alias("s"))
    back = sealed.select("tenant_id", F.aes_decrypt(F.col("s"), F.unhex(F.sha2(F.concat(F.lit("master|"), "tenant_id"), 256)), F.lit("GCM"), F.lit("DEFAULT"), F.col("tenant_id")).cast("string").alias("t"))
    return back.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("t")).alias("chars"))


def versioned_fields(spark: SparkSession, d: str) -> DataFrame:
    """Facts as field rows with their state: tombstone (negative), superseded (a later fact of the key) or current."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and asserted_at is not null")
    f = f.groupBy("tenant_id", "scope", "subject", "predicate", "fact_id", "asserted_at").agg(F.min(F.struct("recorded_at", F.col("object_value").alias("value"), "polarity")).alias("x"))
    f = f.select("tenant_id", "scope", "subject", "predicate", "fact_id", "asserted_at", "x.value", "x.polarity")
    nxt = F.lead("fact_id").over(Window.partitionBy("tenant_id", "scope", "subject", "predicate").orderBy("asserted_at", "fact_id"))
    state = F.when(F.col("polarity") < 0, "tombstone").when(nxt.isNotNull(), "superseded").otherwise("current")
    return f.select("fact_id", "value", state.alias("state"))


def source_quorum(spark: SparkSession, d: str) -> DataFrame:
    """Subject and predicate pairs that two different memories or more agree on, with mean confidence."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and object_value is not null and memory_id is not null and polarity > 0")
    g = f.groupBy("scope", "subject", "predicate", F.lower(F.trim("object_value")).alias("value")).agg(F.countDistinct("memory_id").alias("sources"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return g.where("sources >= 2")


QUERIES = {
    f.__name__: f
    for f in (hybrid_force, directive_latest, episode_neighbours, grounded_evidence, statement_closure, chunk_overlaps, consolidation_pairs, sealed_round_trip, versioned_fields, source_quorum)
}

_TOK, _ITEMS = T.sql_memory_tokens, T.sql_value_items
_TOPIC = f"list_filter({_TOK('text')}, lambda w: w NOT IN ({', '.join(repr(w) for w in R.NO_TOPIC)}))[1:2]"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{n}'" for n, w in R.FAMILIES.items()) + f" WHEN len({_TOPIC}) > 0 THEN 'topic:' || array_to_string({_TOPIC}, '_') ELSE 'general' END"
_FLAT = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_NUM = "list_distinct(regexp_extract_all({x}, '[0-9]+(?:[.][0-9]+)?'))"
_JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0e0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


def _closure() -> str:
    from palimpsest.plans.graph_queries import _paths

    body = _paths("")
    edges = body[body.index("e AS (") : body.index(", h1 AS")]
    own = """f AS (SELECT scope, subject, predicate, object_value, asserted_at AS at_, fact_id AS id FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND scope IS NOT NULL AND asserted_at IS NOT NULL AND predicate IS NOT NULL
UNION ALL SELECT scope, subject, predicate, object_value, valid_from, relation_id FROM entity_relations WHERE subject IS NOT NULL AND object_value IS NOT NULL AND scope IS NOT NULL AND valid_from IS NOT NULL AND predicate IS NOT NULL),
e AS (SELECT scope, subject, object_value, 1.0e0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY scope, subject, predicate ORDER BY at_ DESC, id DESC, object_value DESC) AS rn FROM f) WHERE rn = 1 AND subject <> object_value GROUP BY ALL)"""
    body = body.replace(edges, own).replace("0.78e0", "0.8e0")
    cut = body.rindex("SELECT scope, start, node, hop, round(strength, 6)")
    return body[:cut] + "SELECT scope, start, node, hop, array_to_string(path, ' > ') AS path FROM (SELECT * FROM h2 UNION ALL SELECT * FROM h3)"


SQL = {
    "hybrid_force": f"""WITH q AS (SELECT fact_id, tenant_id, evidence AS query FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at NULLS FIRST, memory_id, evidence, tenant_id NULLS FIRST) AS rn FROM fact_frames WHERE evidence IS NOT NULL AND memory_id IS NOT NULL AND fact_id % 20 = 0) WHERE rn = 1),
qq AS (SELECT fact_id, tenant_id, list_distinct({_TOK('query')}) AS q, {_ITEMS('query')} AS qi FROM q), m AS (SELECT tenant_id, memory_id, list_distinct({_TOK('text')}) AS tok, {_ITEMS('text')} AS items, mass, updated_at FROM memories WHERE text IS NOT NULL AND updated_at IS NOT NULL),
s AS (SELECT fact_id, memory_id, 0.34e0 * ({_JAC.format(a='q', b='tok')}) + 0.22e0 * (len(list_intersect(q, tok)) / greatest(1, len(q))::DOUBLE) + 0.08e0 * (len(list_intersect(qi, items)) / greatest(1, len(qi))::DOUBLE) + 0.06e0 * exp(-greatest(0.0e0, (epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(updated_at)) / 86400000000.0e0) / 365.0e0) + 0.06e0 * coalesce(mass, 0) AS score FROM qq JOIN m USING (tenant_id) WHERE list_has_any(q, tok))
SELECT fact_id, memory_id, score, rank FROM (SELECT fact_id, memory_id, round(score, 6) AS score, row_number() OVER (PARTITION BY fact_id ORDER BY round(score, 6) DESC, memory_id)::INT AS rank FROM s) WHERE rank <= 5""",
    "directive_latest": f"WITH w AS (SELECT DISTINCT write_id, scope, written_at, CASE WHEN lower(trim(kind)) IN ('instruction', 'preference') THEN lower(trim(kind)) WHEN {sql_says('text', R.PREFERENCE)} THEN 'preference' WHEN {sql_says('text', R.INSTRUCTION)} THEN 'instruction' END AS role, {_FAMILY} AS family FROM memory_writes WHERE text IS NOT NULL AND scope IS NOT NULL AND written_at IS NOT NULL), r AS (SELECT scope, role, family, write_id, row_number() OVER (PARTITION BY scope, role, family ORDER BY written_at DESC, write_id DESC)::INT AS place FROM w WHERE role IS NOT NULL) SELECT * FROM r WHERE place <= 2",
    "episode_neighbours": "WITH m AS (SELECT scope, memory_id, mass, row_number() OVER (PARTITION BY scope ORDER BY created_at, memory_id)::INT AS ord, row_number() OVER (PARTITION BY scope ORDER BY mass DESC, memory_id) AS r FROM memories WHERE scope IS NOT NULL AND mass IS NOT NULL AND created_at IS NOT NULL) SELECT DISTINCT m.scope, m.memory_id, m.ord FROM m JOIN m t ON m.scope = t.scope AND t.r <= 3 AND abs(m.ord - t.ord) <= 2",
    "grounded_evidence": f"SELECT DISTINCT fact_id, CASE WHEN coalesce(s, '') = '' THEN 'related_to' ELSE s END AS predicate, round(greatest(0.0e0, least(1.0e0, coalesce(confidence, 0.0e0))), 6) AS confidence, CASE WHEN polarity < 0 THEN -1 ELSE 1 END AS polarity FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(predicate)), '[^a-z0-9_㐀-鿿]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM fact_frames) WHERE fact_id IS NOT NULL AND trim(object_value) <> '' AND contains({_FLAT('evidence')}, {_FLAT('object_value')})",
    "statement_closure": _closure(),
    "chunk_overlaps": "WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0), a AS (SELECT doc_id, s AS start, least(s + 1200, n) AS e FROM (SELECT doc_id, n, unnest(range(0, n, 1000)) AS s FROM d)), b AS (SELECT doc_id, s AS r_start, least(s + 700, n) AS f FROM (SELECT doc_id, n, unnest(range(0, n, 700)) AS s FROM d)) SELECT doc_id, start::INT AS start, r_start::INT AS r_start, (least(e, f) - greatest(start, r_start))::INT AS shared FROM a JOIN b USING (doc_id) WHERE r_start < e AND start < f",
    "consolidation_pairs": f"WITH m AS (SELECT scope, memory_id, mass, text, list_distinct({_TOK('text')}) AS tok FROM memories WHERE text IS NOT NULL AND scope IS NOT NULL AND mass IS NOT NULL) SELECT a.scope, CASE WHEN a.mass >= b.mass THEN a.memory_id ELSE b.memory_id END AS kept, CASE WHEN a.mass >= b.mass THEN b.memory_id ELSE a.memory_id END AS merged FROM m a JOIN m b ON a.scope = b.scope AND a.memory_id < b.memory_id WHERE {_JAC.format(a='a.tok', b='b.tok')} >= 0.8 AND NOT ({T.sql_has_cue('a.text', T.NEGATIONS)} <> {T.sql_has_cue('b.text', T.NEGATIONS)} OR (len({_NUM.format(x='a.text')}) > 0 AND len({_NUM.format(x='b.text')}) > 0 AND NOT list_has_any({_NUM.format(x='a.text')}, {_NUM.format(x='b.text')})))",
    "sealed_round_trip": "SELECT tenant_id, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM memories WHERE text IS NOT NULL AND tenant_id IS NOT NULL GROUP BY tenant_id",
    "versioned_fields": "WITH f AS (SELECT tenant_id, scope, subject, predicate, fact_id, asserted_at, object_value AS value, polarity FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, scope, subject, predicate, fact_id, asserted_at ORDER BY recorded_at NULLS FIRST, object_value NULLS FIRST, polarity NULLS FIRST) AS rn FROM fact_frames WHERE subject IS NOT NULL AND asserted_at IS NOT NULL) WHERE rn = 1) SELECT fact_id, value, CASE WHEN polarity < 0 THEN 'tombstone' WHEN lead(fact_id) OVER (PARTITION BY tenant_id, scope, subject, predicate ORDER BY asserted_at, fact_id) IS NOT NULL THEN 'superseded' ELSE 'current' END AS state FROM f",
    "source_quorum": "SELECT scope, subject, predicate, lower(trim(object_value)) AS value, count(DISTINCT memory_id) AS sources, round(avg(confidence), 6) AS confidence FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND memory_id IS NOT NULL AND polarity > 0 GROUP BY ALL HAVING count(DISTINCT memory_id) >= 2",
}
