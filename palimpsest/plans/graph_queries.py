"""Queries of graphs, ledgers, governance and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluation as E
from palimpsest.operators import governance as V
from palimpsest.operators import graph as G
from palimpsest.operators import ledger as L
from palimpsest.session import read_table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "entity_relations").where("subject is not null and object_value is not null and confidence is not null and scope is not null")
    return r.groupBy("scope", "subject", "object_value").agg(F.max("confidence").alias("w")).where("subject <> object_value")


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("scope", F.col("subject").alias("start")).distinct()


def relation_paths(spark: SparkSession, d: str) -> DataFrame:
    p = G.best_paths(_edges(spark, d), _starts(spark, d), "scope", "subject", "object_value", "w", 3, 0.78, 48)
    return p.select("scope", "start", "node", "hop", F.round("strength", 6).alias("strength"))


def valid_relation_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of up to three hops over the edges that hold on 1 July 2025."""
    at = F.lit("2025-07-01").cast("timestamp")
    r = read_table(spark, d, "entity_relations").where("subject is not null and object_value is not null and confidence is not null and scope is not null and object_is_entity")
    r = r.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    e = r.groupBy("scope", "subject", "object_value").agg(F.max("confidence").alias("w")).where("subject <> object_value")
    p = G.best_paths(e, e.select("scope", F.col("subject").alias("start")).distinct(), "scope", "subject", "object_value", "w", 3, 0.78, 48)
    return p.select("scope", "start", "node", "hop", F.round("strength", 6).alias("strength"))


def two_hop_signal(spark: SparkSession, d: str) -> DataFrame:
    """How strongly organizations by their form mark the entities around them."""
    e = _edges(spark, d)
    marks = e.select("scope", F.col("object_value").alias("node")).unionByName(e.select("scope", F.col("subject").alias("node"))).distinct().where(F.rlike("node", F.lit("(Ltd|GmbH|Corp|Inc|Co)$"))).withColumn("mark", F.lit(1.0))
    return G.reach_signal(e, marks, "scope", "subject", "object_value", "w").select("scope", "node", F.round("signal", 6).alias("signal"))


def shared_entity_edges(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memory_writes").where("entities is not null and scope is not null").groupBy("tenant_id", "scope", "write_id").agg(F.min("entities").alias("e"))
    m = m.withColumn("e", F.array_distinct(F.filter(F.transform("e", lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    return G.shared_entity_edges(m.where(F.size("e") > 0), ["tenant_id", "scope"], "write_id", "e")


def relation_components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_edges(spark, d), "scope", "subject", "object_value")


def entity_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_edges(spark, d), "scope", "subject", "object_value", "w")


def functional_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Edges of single-valued predicates closed by the next edge of their subject."""
    r = read_table(spark, d, "entity_relations").where("subject is not null and valid_from is not null and predicate in ('works at', 'reports to', 'hosted by')")
    r = r.select("relation_id", "tenant_id", "scope", "subject", "predicate", "valid_from", "valid_to").distinct()
    nxt = F.lead("valid_from").over(Window.partitionBy("tenant_id", "scope", "subject", "predicate").orderBy("valid_from", "relation_id"))
    return r.select("relation_id", F.unix_seconds("valid_from").alias("from_s"), F.coalesce(F.unix_seconds(F.least(F.coalesce("valid_to", nxt), F.coalesce(nxt, "valid_to"))), F.lit(-1)).alias("to_s"))


def predicate_ontology(spark: SparkSession, d: str) -> DataFrame:
    """Predicates with their uses; those used three times or more are promoted."""
    r = read_table(spark, d, "entity_relations").where("predicate is not null")
    return r.groupBy("predicate").agg(F.countDistinct("relation_id").alias("uses"), F.count_if(F.col("object_is_entity")).alias("entity_rows")).withColumn("promoted", F.col("uses") >= 3)


def census_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    c = L.census(read_table(spark, d, "events"), "event_type", "ts", "value")
    z = lambda x, v: F.coalesce(F.col(x), F.lit(v)).alias(x)
    return c.select("level", "category", z("month", ""), z("week", -1), z("period", -1), "rows", F.round("total", 2).alias("total"))


def census_best_month(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "fact_frames").where("asserted_at is not null and predicate is not null and confidence is not null").withColumn("month", F.date_format("asserted_at", "yyyy-MM"))
    return L.argmax_period(e, ["predicate"], "month", "confidence").select("predicate", "month", F.round("confidence", 4).alias("total"))


def ledger_live_state(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "fact_frames").where("subject is not null and object_value is not null and asserted_at is not null")
    f = f.groupBy("tenant_id", "scope", "subject", "predicate", "fact_id", "asserted_at").agg(F.min("object_value").alias("object_value"), F.min("polarity").alias("polarity"))
    s = L.live_state(f, ["tenant_id", "scope", "subject", "predicate"], ["asserted_at", "fact_id"], F.col("polarity") < 0, "object_value")
    return s.select("tenant_id", "scope", "subject", "predicate", "object_value", F.unix_seconds("origin").alias("origin_s"), "changes")


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return L.json_leaves(read_table(spark, d, "events").where("props is not null"), "event_id", "props")


_POLICIES = [("auditor", ["read"], [], "restricted"), ("reader", ["read"], [], "internal"), ("guest", ["read"], ["global"], "public"), ("writer", ["write"], [], "restricted")]


def policy_filter(spark: SparkSession, d: str) -> DataFrame:
    policies = spark.createDataFrame(_POLICIES, "principal string, actions array<string>, allowed_scopes array<string>, max_classification string")
    w = read_table(spark, d, "memory_writes").select("write_id", "scope", "classification").distinct()
    ok = V.allowed(w, policies, "scope", "classification", "read")
    return ok.groupBy("principal").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("write_id").alias("writes"))


def replica_placement(spark: SparkSession, d: str) -> DataFrame:
    keys = read_table(spark, d, "memories").select("tenant_id").where("tenant_id is not null").distinct()
    return V.rendezvous(keys, "tenant_id", ["r1", "r2", "r3", "r4", "r5"], 3)


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", V.hash_split(F.col("doc_id").cast("string"), 20).alias("part"))


def sliding_quota(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.withColumn("used", V.sliding_counts(e, ["user_id"], "ts", 3600)).select("event_id", "used")


def delivery_replays(spark: SparkSession, d: str) -> DataFrame:
    return V.replays(read_table(spark, d, "memory_writes"), "write_id", F.col("text"), ["received_at"])


def blind_index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Keyed digests of all different tokens of each memory: a search index that shows no words."""
    m = read_table(spark, d, "memories").where("text is not null").select("memory_id", F.explode(F.array_distinct(T.memory_tokens("text"))).alias("t"))
    return m.select("memory_id", V.hmac_sha256(F.col("t"), b"index-key").alias("term"))


def cold_search(spark: SparkSession, d: str) -> DataFrame:
    """Memories by how many different query tokens they hold, then by time."""
    query = ["review", "march", "cache", "deadline", "policy"]
    m = read_table(spark, d, "memories").where("text is not null and updated_at is not null")
    hits = m.select("memory_id", "updated_at", F.size(F.array_intersect(T.memory_tokens("text"), F.array(*[F.lit(q) for q in query]))).alias("matches")).where("matches > 0")
    return hits.orderBy(F.col("matches").desc(), F.col("updated_at").desc(), "memory_id").limit(100).select("memory_id", "matches")


def digest_chain(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "memories").where("tenant_id is not null and created_at is not null")
    c = V.chained_digests(r, "tenant_id", "created_at", F.concat_ws("|", F.col("memory_id").cast("string"), F.coalesce("text", F.lit(""))))
    return c.select("tenant_id", F.col("day").cast("string").alias("day"), "digest", "chain")


def evidence_token_f1(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "fact_frames").where("evidence is not null and object_value is not null").select("fact_id", "evidence", "object_value")
    r = E.token_f1(f, "fact_id", T.memory_tokens("object_value"), T.memory_tokens("evidence"))
    return r.groupBy("fact_id").agg(F.round(F.max("f1"), 6).alias("f1"))


def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """How well a mass of 0.5 or more tells memories that were used."""
    m = read_table(spark, d, "memories").where("mass is not null and access_count is not null and kind is not null").withColumn("kind", F.lower(F.trim("kind")))
    r = E.classification_report(m, F.col("access_count") > 2, F.col("mass") >= 0.5, "kind")
    return r.select("kind", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("mass is not null and access_count is not null").withColumn("z", 4.0 * F.col("mass") - 2.0)
    r = E.calibrate_temperature(m, "z", F.col("access_count") > 2, [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0])
    return r.select("temperature", F.round("brier", 6).alias("brier"))


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("mass is not null and access_count is not null")
    r = E.tune_threshold(m, "mass", F.col("access_count") > 2, [x / 10 for x in range(1, 10)], 0.5)
    return r.select("threshold", F.round("recall", 6).alias("recall"), F.round("contamination", 6).alias("contamination"))


def size_percentile(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "documents").where("n_chars is not null").withColumn("src", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    return E.positional_percentile(m, "src", "n_chars", 0.95).select("src", F.col("n_chars").alias("p95"))


def usefulness_bound(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memory_records").where("state is not null").groupBy("memory_id").agg(F.count_if(F.col("active") == 1).alias("good"), F.count_if(F.col("active") == 0).alias("bad"))
    return m.select("memory_id", F.round(E.beta_lower_bound(F.col("good"), F.col("bad")), 6).alias("bound"))


QUERIES = {
    f.__name__: f
    for f in (
        relation_paths, valid_relation_paths, two_hop_signal, shared_entity_edges, relation_components, entity_communities, functional_intervals, predicate_ontology,
        census_grouping_sets, census_best_month, ledger_live_state, json_leaves, policy_filter, replica_placement, hash_split, sliding_quota, delivery_replays, blind_index_terms, cold_search,
        digest_chain, evidence_token_f1, gate_report, temperature_grid, threshold_grid, size_percentile, usefulness_bound,
    )
}

_E = "e AS (SELECT scope, subject, object_value, max(confidence) AS w FROM entity_relations WHERE subject IS NOT NULL AND object_value IS NOT NULL AND confidence IS NOT NULL AND scope IS NOT NULL{more} GROUP BY ALL HAVING subject <> object_value)"


def _paths(more: str) -> str:
    hop = "SELECT scope, start, node, {h} AS hop, strength, path FROM (SELECT *, row_number() OVER (PARTITION BY scope, start ORDER BY round(strength, 9) DESC, array_to_string(path, '>')) AS b FROM (SELECT *, row_number() OVER (PARTITION BY scope, start, node ORDER BY round(strength, 9) DESC, array_to_string(path, '>')) AS n FROM ({src})) WHERE n = 1) WHERE b <= 48"
    first = "SELECT scope, subject AS start, object_value AS node, w * 0.78e0 AS strength, [subject, object_value] AS path FROM e"
    later = "SELECT p.scope, start, object_value AS node, strength * w * 0.78e0 AS strength, list_append(path, object_value) AS path FROM {p} p JOIN e ON p.scope = e.scope AND p.node = e.subject WHERE NOT list_contains(path, object_value)"
    return f"WITH {_E.format(more=more)}, h1 AS ({hop.format(h=1, src=first)}), h2 AS ({hop.format(h=2, src=later.format(p='h1'))}), h3 AS ({hop.format(h=3, src=later.format(p='h2'))}) SELECT scope, start, node, hop, round(strength, 6) AS strength FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"


_TOK = T.sql_memory_tokens
SQL = {
    "relation_paths": _paths(""),
    "valid_relation_paths": _paths(" AND object_is_entity AND (valid_from IS NULL OR valid_from <= TIMESTAMPTZ '2025-07-01 00:00:00+00') AND (valid_to IS NULL OR TIMESTAMPTZ '2025-07-01 00:00:00+00' < valid_to)"),
    "two_hop_signal": f"WITH {_E.format(more='')}, m AS (SELECT DISTINCT scope, node FROM (SELECT scope, subject AS node FROM e UNION ALL SELECT scope, object_value FROM e) WHERE regexp_matches(node, '(Ltd|GmbH|Corp|Inc|Co)$')), o AS (SELECT e.scope, subject AS node, w * 0.72e0 AS g FROM e JOIN m ON e.scope = m.scope AND object_value = m.node), o1 AS (SELECT scope, node, max(g) AS g FROM o GROUP BY ALL), t AS (SELECT e.scope, subject AS node, w * 0.72e0 * g AS g FROM e JOIN o1 ON e.scope = o1.scope AND object_value = o1.node), b AS (SELECT scope, node, max(g) AS g FROM (SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY ALL) SELECT coalesce(b.scope, m.scope) AS scope, coalesce(b.node, m.node) AS node, round(least(1.0e0, 0.68e0 * CASE WHEN m.node IS NULL THEN 0 ELSE 1 END + 0.32e0 * coalesce(g, 0)), 6) AS signal FROM b FULL JOIN m ON b.scope = m.scope AND b.node = m.node",
    "shared_entity_edges": "WITH m AS (SELECT tenant_id, scope, write_id, list_distinct(list_filter(list_transform(min(entities), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS l FROM memory_writes WHERE entities IS NOT NULL AND scope IS NOT NULL GROUP BY ALL), e AS (SELECT tenant_id, scope, write_id, len(l) AS n, unnest(l) AS x FROM m), p AS (SELECT a.tenant_id, a.scope, a.write_id AS a, b.write_id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE, 6) AS weight FROM e a JOIN e b ON a.tenant_id = b.tenant_id AND a.scope = b.scope AND a.x = b.x AND a.write_id < b.write_id GROUP BY ALL), q AS (SELECT *, unnest([a, b]) AS z FROM p WHERE weight >= 0.34), r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, scope, z ORDER BY weight DESC, a, b) AS rn FROM q) SELECT tenant_id, scope, a, b, weight FROM r WHERE rn <= 24 GROUP BY ALL HAVING count(*) = 2",
    "relation_components": f"WITH RECURSIVE {_E.format(more='')}, u AS (SELECT scope, subject AS a, object_value AS b FROM e UNION SELECT scope, object_value, subject FROM e), r AS (SELECT scope, a AS node, a AS seen FROM u UNION SELECT r.scope, r.node, u.b FROM r JOIN u ON r.scope = u.scope AND r.seen = u.a) SELECT scope, node, min(seen) AS component FROM r GROUP BY ALL",
    "functional_intervals": "WITH r AS (SELECT DISTINCT relation_id, tenant_id, scope, subject, predicate, valid_from, valid_to FROM entity_relations WHERE subject IS NOT NULL AND valid_from IS NOT NULL AND predicate IN ('works at', 'reports to', 'hosted by')), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY tenant_id, scope, subject, predicate ORDER BY valid_from, relation_id) AS nxt FROM r) SELECT relation_id, CAST(epoch(valid_from) AS BIGINT) AS from_s, coalesce(CAST(epoch(least(coalesce(valid_to, nxt), coalesce(nxt, valid_to))) AS BIGINT), -1) AS to_s FROM n",
    "predicate_ontology": "SELECT predicate, count(DISTINCT relation_id) AS uses, count(*) FILTER (object_is_entity) AS entity_rows, count(DISTINCT relation_id) >= 3 AS promoted FROM entity_relations WHERE predicate IS NOT NULL GROUP BY predicate",
    "census_grouping_sets": "WITH x AS (SELECT event_type AS category, strftime(ts, '%Y-%m') AS month, ((day(ts) - 1) // 7 + 1)::INT AS week, (date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) // 30)::INT AS period, value FROM events) SELECT CASE grouping(category, month, week, period) WHEN 7 THEN 'category' WHEN 3 THEN 'month' WHEN 1 THEN 'week' ELSE 'window' END AS level, category, coalesce(month, '') AS month, coalesce(week, -1) AS week, coalesce(period, -1) AS period, count(*) AS rows, round(sum(value), 2) AS total FROM x GROUP BY GROUPING SETS ((category), (category, month), (category, month, week), (category, period))",
    "census_best_month": "WITH s AS (SELECT predicate, strftime(asserted_at, '%Y-%m') AS month, sum(confidence) AS t FROM fact_frames WHERE asserted_at IS NOT NULL AND predicate IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL) SELECT predicate, month, round(t, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY round(t, 6) DESC, month) AS rn FROM s) WHERE rn = 1",
    "ledger_live_state": "WITH f AS (SELECT tenant_id, scope, subject, predicate, fact_id, asserted_at, min(object_value) AS v, (min(polarity) < 0)::INT AS e FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND asserted_at IS NOT NULL GROUP BY ALL), l AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY tenant_id, scope, subject, predicate ORDER BY asserted_at, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life, row_number() OVER (PARTITION BY tenant_id, scope, subject, predicate ORDER BY asserted_at DESC, fact_id DESC) AS back FROM f), t AS (SELECT tenant_id, scope, subject, predicate, life FROM l WHERE back = 1 AND e = 0) SELECT l.tenant_id, l.scope, l.subject, l.predicate, max(v) FILTER (back = 1) AS object_value, CAST(epoch(min(asserted_at)) AS BIGINT) AS origin_s, count(*) FILTER (e = 0) AS changes FROM l JOIN t ON l.tenant_id IS NOT DISTINCT FROM t.tenant_id AND l.scope IS NOT DISTINCT FROM t.scope AND l.subject = t.subject AND l.predicate IS NOT DISTINCT FROM t.predicate AND l.life = t.life GROUP BY ALL",
    "json_leaves": "SELECT event_id, replace(substr(fullkey, 3), '\"', '') AS path, json_extract_string(atom, '$') AS value FROM (SELECT event_id, j.fullkey, j.atom FROM events, json_tree(props) j WHERE j.atom IS NOT NULL) WHERE json_extract_string(atom, '$') <> ''",
    "policy_filter": "WITH p(principal, act, sc, mx) AS (VALUES ('auditor', true, '', 3), ('reader', true, '', 1), ('guest', true, 'global', 0), ('writer', false, '', 3)), w AS (SELECT DISTINCT write_id, scope, CASE coalesce(classification, 'internal') WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 3 END AS l FROM memory_writes) SELECT principal, count(*) AS rows, count(DISTINCT write_id) AS writes FROM w JOIN p ON act AND (sc = '' OR sc = coalesce(scope, '')) AND l <= mx GROUP BY principal",
    "replica_placement": "WITH k AS (SELECT DISTINCT tenant_id FROM memories WHERE tenant_id IS NOT NULL), f AS (SELECT tenant_id, replica, ('0x' || substr(sha256(tenant_id || ':' || replica), 1, 15))::BIGINT AS f FROM k, (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5')) v(replica)) SELECT tenant_id, replica, place FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY f DESC, replica)::INT AS place FROM f) WHERE place <= 3",
    "hash_split": "SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 20 THEN 'dev' ELSE 'holdout' END AS part FROM documents",
    "sliding_quota": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS used FROM events",
    "delivery_replays": "SELECT write_id, count(*) AS deliveries, min(coalesce(text, '')) <> max(coalesce(text, '')) AS conflict FROM memory_writes GROUP BY write_id HAVING count(*) > 1",
    "cold_search": f"WITH h AS (SELECT memory_id, updated_at, len(list_intersect({_TOK('text')}, ['review', 'march', 'cache', 'deadline', 'policy']))::INT AS matches FROM memories WHERE text IS NOT NULL AND updated_at IS NOT NULL) SELECT memory_id, matches FROM h WHERE matches > 0 ORDER BY matches DESC, updated_at DESC, memory_id LIMIT 100",
    "digest_chain": "WITH h AS (SELECT tenant_id, created_at::DATE AS day, sha256(memory_id || '|' || coalesce(text, '')) AS h FROM memories WHERE tenant_id IS NOT NULL AND created_at IS NOT NULL), p AS (SELECT tenant_id, day, left(h, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL), d AS (SELECT tenant_id, day, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM p GROUP BY ALL), l AS (SELECT *, list(digest) OVER (PARTITION BY tenant_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS so FROM d) SELECT tenant_id, day::VARCHAR AS day, digest, list_reduce(list_prepend('', so), lambda a, x: sha256(a || x)) AS chain FROM l",
    "evidence_token_f1": f"WITH f AS (SELECT DISTINCT fact_id, {_TOK('object_value')} AS p, {_TOK('evidence')} AS r FROM fact_frames WHERE evidence IS NOT NULL AND object_value IS NOT NULL), g AS (SELECT *, row_number() OVER () AS k FROM f), a AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(p) AS w FROM g) GROUP BY ALL), b AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(r) AS w FROM g) GROUP BY ALL), s AS (SELECT k, sum(least(a.c, b.c)) AS same FROM a JOIN b USING (k, w) GROUP BY k) SELECT fact_id, round(max(CASE WHEN len(p) + len(r) = 0 THEN 1.0e0 ELSE 2.0e0 * coalesce(same, 0) / (len(p) + len(r)) END), 6) AS f1 FROM g LEFT JOIN s USING (k) GROUP BY fact_id",
    "gate_report": "WITH m AS (SELECT lower(trim(kind)) AS kind, access_count > 2 AS y, mass >= 0.5 AS p FROM memories WHERE mass IS NOT NULL AND access_count IS NOT NULL AND kind IS NOT NULL), c AS (SELECT kind, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM m GROUP BY kind), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS rc FROM c) SELECT kind, tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn)::DOUBLE END, 6) AS fpr FROM r",
    "temperature_grid": "WITH m AS (SELECT 4.0e0 * mass - 2.0e0 AS z, (access_count > 2)::INT AS y, unnest([0.5e0, 0.75e0, 1.0e0, 1.5e0, 2.0e0, 3.0e0, 5.0e0]) AS temperature FROM memories WHERE mass IS NOT NULL AND access_count IS NOT NULL) SELECT temperature, round(b, 6) AS brier FROM (SELECT temperature, round(avg((1 / (1 + exp(-z / temperature)) - y) ** 2), 9) AS b FROM m GROUP BY temperature) ORDER BY b, temperature LIMIT 1",
    "threshold_grid": "WITH m AS (SELECT mass, access_count > 2 AS y, unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS threshold FROM memories WHERE mass IS NOT NULL AND access_count IS NOT NULL), b AS (SELECT threshold, coalesce(count(*) FILTER (mass >= threshold AND y) / nullif(count(*) FILTER (y), 0)::DOUBLE, 0) AS recall, coalesce(count(*) FILTER (mass >= threshold AND NOT y) / nullif(count(*) FILTER (mass >= threshold), 0)::DOUBLE, 0) AS contamination FROM m GROUP BY threshold) SELECT threshold, round(recall, 6) AS recall, round(contamination, 6) AS contamination FROM b ORDER BY (contamination <= 0.5) DESC, CASE WHEN contamination <= 0.5 THEN -recall ELSE contamination END, threshold DESC LIMIT 1",
    "size_percentile": "WITH m AS (SELECT coalesce(lower(trim(source)), '') AS src, n_chars FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY src) AS n FROM m) SELECT src, n_chars AS p95 FROM r WHERE rn = ceil(n * 0.95e0)",
    "usefulness_bound": "WITH m AS (SELECT memory_id, count(*) FILTER (active = 1) + 1.0e0 AS a, count(*) FILTER (active = 0) + 1.0e0 AS b FROM memory_records WHERE state IS NOT NULL GROUP BY memory_id) SELECT memory_id, round(a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bound FROM m",
}
