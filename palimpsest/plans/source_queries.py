"""Queries of query modes, chunking, distillation, encoders, formats and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import chunks as K
from palimpsest.functions import modes as M
from palimpsest.functions import text as T
from palimpsest.functions.encoders import hash_encoder
from palimpsest.operators import vectors as V
from palimpsest.session import read_table, scratch_dir
from palimpsest.sources import formats as S
from palimpsest.streaming import streams as R

QUESTIONS = [
    "When did Maya arrive?", "Would Maya likely enjoy hiking?", "Why did Maya move?", "What color is the car?", "What tasks remain now?", "How did my trip plan change?",
    "List all books I read before March", "Which library should I use for charts?", "How do I implement a parser?", "In what order did the events happen?", "These notes contradict each other; which is correct?",
    "What is linked to the harbor project through its owners?", "What is the latest limit of service api-7?", "How much did I spend in total in 2025?", "Nobody has never been there", "当前任务还有哪些？", "为什么计划没有改变？", "",
]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, query string")


def query_modes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return _questions(spark).select("id", *[c.alias(n) for n, c in M.query_modes(q).items()], M.matches(q, "negated").alias("negated"))


def query_budgets(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return _questions(spark).select("id", M.satellite_budget(q).alias("satellites"), M.constellation_budget(q).alias("constellation"), M.hop_limit(q).alias("hops"))


def query_weights(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark).select("id", *[F.round(c, 6).alias(n) for n, c in M.signal_weights(F.col("query")).items()])


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(K.fixed_chunks(F.col("text"))).alias("chunk", "t")).select("doc_id", "chunk", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


def dated_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(K.dated_blocks(F.col("text"))).alias("block", "t")).select("doc_id", "block", F.length("t").alias("chars"))


def user_turns(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(K.user_turns(F.col("text")), 256).alias("digest"))


def distilled_texts(spark: SparkSession, d: str) -> DataFrame:
    text, mass = K.distilled(F.col("text"))
    return read_table(spark, d, "memories").where("text is not null").select("memory_id", text.alias("distilled"), F.round(mass, 6).alias("mass"))


def date_names(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("created_at is not null").select("memory_id", F.to_date("created_at").alias("day"))
    return m.select("memory_id", K.date_names(F.col("day"), F.lit("2025-08-08").cast("date")).alias("names"))


def hash_encoder_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Nearest subject gloss of each memory by the hashing encoder; rows are projected, not joined."""
    enc = hash_encoder(384)
    areas = read_table(spark, d, "subject_areas").where("subject is not null").select("subject", enc(F.concat_ws(" ", "subject", "gloss")).alias("centre"))
    m = read_table(spark, d, "memories").where("text is not null").select("memory_id", enc(F.col("text")).alias("v"))
    return V.best_centroid(m, "v", areas, "subject")


def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Late interaction score of each fact's evidence with its memory, over hashed token vectors of 64 dimensions."""
    enc = hash_encoder(64)
    f = read_table(spark, d, "fact_frames").where("evidence is not null and memory_id is not null").select("fact_id", "memory_id", "evidence").distinct()
    m = read_table(spark, d, "memories").where("text is not null").select("memory_id", "text")
    pairs = f.join(m, "memory_id").withColumn("q", F.array_distinct(T.memory_tokens("evidence"))).withColumn("t", F.array_distinct(T.memory_tokens("text")))
    words = pairs.select(F.explode(F.concat("q", "t")).alias("w")).distinct().withColumn("v", enc(F.col("w")))
    side = lambda c: pairs.select("fact_id", F.explode(c).alias("w")).distinct().join(words, "w").groupBy("fact_id").agg(F.collect_list("v").alias(c + "v"))
    return side("q").join(side("t"), "fact_id").select("fact_id", F.round(V.max_sim(None, "qv", "tv"), 4).alias("score"))


def format_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows and text lengths of the facts after a trip through each format."""
    f = read_table(spark, d, "fact_frames").select("fact_id", "subject", "predicate", "object_value")
    schema, out = "fact_id long, subject string, predicate string, object_value string", None
    for kind in ("jsonl", "csv", "parquet", "orc"):
        path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex[:12]}"
        S.write_any(f, path, kind)
        back = S.read_any(spark, path, kind, schema).agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.sum("fact_id").alias("ids"), F.sum(F.length("object_value")).alias("chars"), F.count("subject").alias("subjects")
        )
        out = back if out is None else out.unionByName(back)
    return out


def snapshot_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The newest of two revisions of a table."""
    path = f"{scratch_dir(spark)}/revisions-{uuid.uuid4().hex[:12]}"
    a = read_table(spark, d, "subject_areas")
    S.write_snapshot(a.withColumn("gloss", F.upper("gloss")), path, 1)
    S.write_snapshot(a, path, 2)
    return S.read_snapshot(spark, path)


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.even_sample(read_table(spark, d, "documents").select("doc_id"), ["doc_id"], 25)


def first_per_source(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "documents").where("source is not null").select("source", "doc_id")
    return S.first_per_group(m, ["source"], ["doc_id"], 3)


def dialogue_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of nested sessions: the lines of a document with a speaker mark."""
    line = F.split(F.col("text"), "\n")
    spoken = F.filter(line, lambda s: F.rlike(s, F.lit("^(?:user|assistant): ")))
    turns = F.transform(spoken, lambda s: F.struct(F.substring_index(s, ":", 1).alias("role"), F.substr(s, F.instr(s, ":") + 2).alias("content")))
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.array(turns).alias("s"))
    return S.dialogue_turns(docs, ["doc_id"], F.col("s")).select("doc_id", "turn", "role", F.length("text").alias("chars"))


def daily_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a scope's memories of one day, in order, as one."""
    m = read_table(spark, d, "memories").where("text is not null and created_at is not null and scope is not null")
    g = m.groupBy("scope", F.to_date("created_at").alias("day")).agg(F.array_sort(F.collect_list(F.struct("memory_id", "text"))).alias("x"))
    return g.select("scope", F.col("day").cast("string").alias("day"), F.size("x").alias("rows"), F.sha2(F.array_join(F.transform("x", lambda x: x["text"]), "\n"), 256).alias("digest"))


def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Write calls as a stream, each write once."""
    s = R.table_stream(spark, f"{d}/memory_writes.parquet").select("write_id", "tenant_id", "received_at").where("received_at is not null")
    out = R.run_available(R.deduplicated(s, ["write_id"], "received_at", "3650 days"), "append", "dedup")
    return out.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("writes"))


def stream_window_quota(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day of a stream; days that the watermark has not passed yet are left out."""
    s = R.table_stream(spark, f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = R.run_available(R.window_quota(s, ["event_type"], "ts", "1 day", "1 day", "1 hour"), "append", "quota")
    return out.select("event_type", F.unix_seconds("window.start").alias("start_s"), "events")


def stream_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = R.table_stream(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = R.run_available(R.gap_sessions(s, ["user_id"], "ts", "2 hours", "1 hour"), "append", "gaps")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "events")


def stream_versioned_writes(spark: SparkSession, d: str) -> DataFrame:
    """Facts as a stream of writes into one state per subject and predicate; late or weak corrections go to review."""
    s = R.table_stream(spark, f"{d}/fact_frames.parquet").where("subject is not null and object_value is not null and asserted_at is not null")
    s = s.select(F.concat_ws("|", "tenant_id", "scope", "subject", "predicate").alias("key"), F.col("object_value").alias("value"), F.col("asserted_at").alias("at"), F.coalesce("confidence", F.lit(0.5)).alias("trust"))
    out = R.run_available(R.versioned_writes(s), "append", "versions")
    return out.groupBy("action").agg(F.count(F.lit(1)).alias("writes"), F.countDistinct("key").alias("keys"))


QUERIES = {
    f.__name__: f
    for f in (
        query_modes, query_budgets, query_weights, fixed_chunks, dated_blocks, user_turns, distilled_texts, date_names, hash_encoder_neighbours, late_interaction, format_round_trip, snapshot_revisions,
        even_sample, first_per_source, dialogue_turns, daily_groups, stream_deduplicated, stream_window_quota, stream_gap_sessions, stream_versioned_writes,
    )
}

_VALUES = "q(id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ")"
_m = lambda n: M.sql_matches("query", n)
_SCALE = {"temporal": f"CASE WHEN {_m('time_words')} OR {_m('years')} THEN 1.9e0 ELSE 1 END", "graph": f"CASE WHEN {_m('graph_words')} THEN 1.8e0 ELSE 1 END", "entity": f"CASE WHEN {_m('graph_words')} THEN 1.35e0 ELSE 1 END", "bm25": f"CASE WHEN {_m('exact')} THEN 1.7e0 ELSE 1 END"}
_RAW = {k: f"{w}e0 * {_SCALE.get(k, '1')}" for k, w in M.SIGNAL_WEIGHTS.items()}
_TRIP = " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS rows, sum(fact_id)::BIGINT AS ids, sum(length(object_value))::BIGINT AS chars, count(subject) AS subjects FROM fact_frames" for k in ("jsonl", "csv", "parquet", "orc"))


def _score(c: str) -> str:
    hit = lambda p, w: f"{w} * regexp_matches(lower({c}), '{p.replace(chr(39), chr(39) * 2)}')::INT"
    return f"({hit(K.FACT, 3)} + {hit(K.STATE, 2)} + {hit(K.EVENT, 2)} + {hit(K.NUMBER, 1)} - {hit(K.REQUEST, 3)})"


SQL = {
    "query_modes": f"WITH {_VALUES} SELECT id, {_m('broad_set')} AS broad_set, {_m('current_words')} AND NOT {_m('historical')} AS current_state, {_m('historical')} AS historical, {_m('task')} OR {_m('contradiction')} AS instructions, {_m('preference')} OR {_m('task')} OR {_m('contradiction')} AS preferences, {_m('episodic')} AS episodic, {_m('contradiction')} AS contradiction, {_m('negated')} AS negated FROM q",
    "query_budgets": f"WITH {_VALUES} SELECT id, least(20, CASE WHEN {_m('inference')} THEN 20 WHEN {_m('temporal_point')} THEN 6 WHEN {_m('causal')} THEN 12 ELSE 8 END) AS satellites, CASE WHEN {_m('broad_set')} THEN 40 WHEN {_m('historical')} THEN 24 ELSE 16 END AS constellation, CASE WHEN {_m('deep_graph')} THEN 8 ELSE 4 END AS hops FROM q",
    "query_weights": f"WITH {_VALUES}, r AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _RAW.items())} FROM q) SELECT id, {', '.join(f'round({k} / ({chr(43).join(_RAW)}), 6) AS {k}' for k in _RAW)} FROM r",
    "fixed_chunks": "WITH c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1000) END) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, (s // 1000)::INT AS chunk, length(substr(text, s + 1, 1200))::INT AS chars, sha256(substr(text, s + 1, 1200)) AS digest FROM c",
    "first_per_source": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 3",
    "user_turns": "WITH t AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda s: starts_with(lower(trim(s)), 'user:')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(CASE WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda s: trim(substr(trim(s), 6))), ' ') ELSE text END) AS digest FROM t",
    "distilled_texts": f"WITH c AS (SELECT memory_id, regexp_replace(trim(unnest(string_split_regex(text, '[.!?]+\\s+|\\s+(?:but|however|by the way|also)\\s+'))), '\\s+', ' ', 'g') AS c FROM memories WHERE text IS NOT NULL), s AS (SELECT memory_id, c, {_score('c')} AS s FROM c WHERE length(c) >= 12), r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY s DESC, length(c) DESC, c) AS rn FROM s WHERE s > 0), g AS (SELECT memory_id, string_agg(c, ' ' ORDER BY rn) AS t, sum(s) AS s FROM r WHERE rn <= 8 GROUP BY memory_id) SELECT memory_id, coalesce(t, '') AS distilled, round(least(1.0e0, coalesce(s, 0) / 20.0e0), 6) AS mass FROM memories LEFT JOIN g USING (memory_id) WHERE text IS NOT NULL",
    "format_round_trip": _TRIP,
    "snapshot_revisions": "SELECT subject, gloss FROM subject_areas",
    "even_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), p AS (SELECT DISTINCT round_even(k * (n - 1) / 24.0e0, 0)::BIGINT AS pos FROM (SELECT DISTINCT n FROM r), range(25) t(k)) SELECT doc_id FROM r JOIN p USING (pos)",
    "dialogue_turns": "WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^(?:user|assistant): ')) AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS turn FROM t) SELECT doc_id, turn::INT AS turn, split_part(s, ':', 1) AS role, length(substr(s, instr(s, ':') + 2))::INT AS chars FROM u",
    "daily_groups": "SELECT scope, created_at::DATE::VARCHAR AS day, count(*)::INT AS rows, sha256(string_agg(text, chr(10) ORDER BY memory_id, text)) AS digest FROM memories WHERE text IS NOT NULL AND created_at IS NOT NULL AND scope IS NOT NULL GROUP BY ALL",
    "stream_deduplicated": "SELECT tenant_id, count(*) AS writes FROM (SELECT write_id, any_value(tenant_id) AS tenant_id FROM memory_writes WHERE received_at IS NOT NULL GROUP BY write_id) GROUP BY tenant_id",
    "stream_window_quota": "WITH w AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS events FROM events GROUP BY ALL) SELECT event_type, CAST(epoch(d) AS BIGINT) AS start_s, events FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_gap_sessions": "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum((p IS NULL OR ts > p + INTERVAL 2 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l), s AS (SELECT user_id, g, min(ts) AS a, max(ts) + INTERVAL 2 HOURS AS b, count(*) AS events FROM g GROUP BY ALL) SELECT user_id, epoch_us(a) AS start_us, events FROM s WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
}
