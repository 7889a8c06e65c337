"""Queries of upkeep: access rights, expiry, capacity, index changes, keys, deletion, replicas, usage and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import governance as V
from palimpsest.operators import lifecycle as C
from palimpsest.operators import upkeep as U
from palimpsest.plans.lifecycle_queries import NOW, first_deliveries
from palimpsest.session import read_table


def _now():
    return F.lit(NOW).cast("timestamp")


def expired_memories(spark: SparkSession, d: str) -> DataFrame:
    """Unpinned memories older than two half-lives of their kind."""
    m = read_table(spark, d, "memories").where("memory_id is not null")
    ends = C.expiry(F.col("created_at"), F.lower(F.trim("kind")), 2.0)
    return U.expired(m.where("not coalesce(pinned, false)"), ends, _now()).select("memory_id", "kind")


def within_capacity(spark: SparkSession, d: str) -> DataFrame:
    """The 500 memories of the highest retention that stay active; pinned ones always stay."""
    m = read_table(spark, d, "memories").where("mass is not null and updated_at is not null and memory_id is not null")
    m = m.withColumn("source_trust", F.coalesce("confidence", F.lit(0.4))).withColumn("utility", F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 10.0))
    return U.keep_best(m, "memory_id", C.retention_score(_now()), 500).select("memory_id", F.col("_s").alias("score"))


def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """What an index must take up and drop between successive snapshots: by tenant, digests against digests."""
    r = read_table(spark, d, "memory_records").where("snapshot_at is not null and memory_id is not null and digest is not null")
    last = r.groupBy("tenant_id", "memory_id", "snapshot_at").agg(F.max(F.struct("loaded_at", "active", "digest")).alias("x")).select("tenant_id", "memory_id", "snapshot_at", "x.active", "x.digest")
    c = U.snapshot_changes(last, ["tenant_id", "memory_id"], "snapshot_at", "digest", F.col("active") == 1)
    g = c.groupBy("snapshot_at").agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "changed", "removed")])
    return g.select(F.unix_seconds("snapshot_at").alias("snapshot_s"), "added", "changed", "removed")


def active_index(spark: SparkSession, d: str) -> DataFrame:
    """Entity mentions of memories that the last snapshot calls active, by tenant: the others leave every index."""
    r = read_table(spark, d, "memory_records").where("snapshot_at is not null and memory_id is not null")
    state = r.groupBy("memory_id").agg(F.max(F.struct("snapshot_at", "loaded_at", "active")).alias("x"))
    items = read_table(spark, d, "entity_items").where("memory_id is not null").select("tenant_id", "item_id", "memory_id").distinct()
    return U.only_active(items, state.where("x.active = 1").select("memory_id"), "memory_id").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("memory_id").alias("memories"))


def access_rights(spark: SparkSession, d: str) -> DataFrame:
    """Latest role of each session in a tenant (its last write decides), and whether it reaches that of a writer."""
    w = first_deliveries(read_table(spark, d, "memory_writes").select("write_id", "received_at", "tenant_id", "session_key", "source", "written_at")).where("tenant_id is not null and session_key is not null")
    role = F.when(F.lower(F.trim("source")) == "user", "admin").when(F.lower(F.trim("source")).isin("tool", "verified_tool"), "writer").otherwise("reader")
    acl = U.latest_grants(w.withColumn("role", role), ["tenant_id", "session_key"], "role", ["written_at", "write_id"])
    return acl.select("tenant_id", "session_key", "role", U.reaches(F.col("role"), "writer").alias("may_write"))


def erased_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts after every memory whose id is divisible by 50 is deleted for good: its rows go, texts that name it are blanked."""
    f = read_table(spark, d, "fact_frames").where("fact_id is not null").select("fact_id", "memory_id", "tenant_id", "evidence").distinct()
    gone = read_table(spark, d, "memories").where("memory_id % 50 = 0").select("memory_id")
    kept = U.erase(f, gone, "memory_id")
    return kept.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.length("evidence")).alias("chars"))


def key_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Texts opened with the old key of their tenant, sealed with the new one and opened again: unchanged rows per tenant."""
    m = read_table(spark, d, "memories").where("text is not null and tenant_id is not null").select("tenant_id", "text")
    sealed = m.select("tenant_id", "text", V.sealed(F.col("text"), F.col("tenant_id"), "old").alias("s"))
    turned = sealed.select("tenant_id", "text", V.sealed(V.opened(F.col("s"), F.col("tenant_id"), "old"), F.col("tenant_id"), "new").alias("s"))
    same = V.opened(F.col("s"), F.col("tenant_id"), "new") == F.col("text")
    return turned.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("unchanged"))


def replica_reads(spark: SparkSession, d: str) -> DataFrame:
    """For each tenant the replica to read from and those behind it; customers of a nation stand for its replica's state."""
    keys = read_table(spark, d, "memories").where("tenant_id is not null").select("tenant_id").distinct()
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("replica"), F.pmod(F.col("n_nationkey"), F.lit(4)).alias("revision"), (F.pmod(F.col("n_nationkey"), F.lit(7)) * 100.0).alias("lag_ms"), (F.pmod(F.col("n_nationkey"), F.lit(5)) * 20.0).alias("latency_ms"), (F.pmod(F.col("n_nationkey"), F.lit(6)) != 0).alias("healthy"))
    return U.replica_reads(keys, "tenant_id", n).select("tenant_id", "reader", "revision", F.array_join("stale", ",").alias("stale"))


def operation_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts and times of each kind of event, and whether they are evidence of a long run (1,000 events, a week, 99 % good)."""
    e = read_table(spark, d, "events").where("event_type is not null and ts is not null and value is not null")
    r = U.operation_report(e, "event_type", "ts", F.col("value"), F.col("value") < 200)
    return r.select("operation", "samples", "successes", F.round("mean", 4).alias("mean"), F.round("most", 4).alias("most"), F.round("hours", 4).alias("hours"), "long_running")


def invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule of the stored state, by rule."""
    m, f, r = (read_table(spark, d, t) for t in ("memories", "fact_frames", "entity_relations"))
    bad_times = F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull() & (F.col("valid_to") <= F.col("valid_from"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = [
        U.broken(m, "mass lies in [0, 1]", ~F.col("mass").between(0, 1)), U.broken(m, "confidence lies in [0, 1]", ~F.col("confidence").between(0, 1)), U.broken(m, "updates follow creation", F.col("updated_at") < F.col("created_at")),
        U.broken(f, "facts end after they begin", bad_times), U.broken(r, "relations end after they begin", bad_times), U.broken(f, "facts have a confidence in [0, 1]", ~F.col("confidence").between(0, 1)),
        U.broken(r, "relations name both ends", blank("subject") | blank("predicate") | blank("object_value")),
        U.broken(U.dangling(f, m, "memory_id"), "facts belong to a memory", F.lit(True)), U.broken(U.dangling(read_table(spark, d, "memories"), read_table(spark, d, "memory_writes"), "write_id"), "memories come from a write", F.lit(True)),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def derived_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Names as derived records of the memories that mention them: valid with two known sources or more, stale if one of them was archived."""
    i = read_table(spark, d, "entity_items").where("name is not null and memory_id is not null and scope is not null").select("scope", "name", "memory_id").distinct()
    r = read_table(spark, d, "memory_records").where("snapshot_at is not null and memory_id is not null")
    gone = r.groupBy("memory_id").agg(F.max(F.struct("snapshot_at", "loaded_at", F.lower(F.trim("state")).alias("state"))).alias("x")).where("x.state in ('archived', 'invalidated')").select("memory_id")
    v = U.lineage(i, ["scope", "name"], "memory_id", read_table(spark, d, "memories").select("memory_id"), gone)
    return v.select("scope", "name", "sources", "valid", "stale")


def quarantined_support(spark: SparkSession, d: str) -> DataFrame:
    """Facts of low confidence, capped at 0.45 until two different memories or more support the same value."""
    f = read_table(spark, d, "fact_frames").where("subject is not null and object_value is not null and scope is not null and confidence is not null and fact_id is not null and predicate is not null")
    f = f.select("fact_id", "scope", "subject", "predicate", F.lower(F.trim("object_value")).alias("value"), "memory_id", "confidence").distinct()
    return U.capped_until_supported(f, ["scope", "subject", "predicate", "value"], "memory_id", "confidence", 0.45).select("fact_id", F.round("confidence", 6).alias("confidence")).distinct()


def utility_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Moving average of the usefulness of each memory, over its snapshots in order (active counts as useful)."""
    r = read_table(spark, d, "memory_records").where("snapshot_at is not null and memory_id is not null and active is not null")
    r = r.groupBy("memory_id", "snapshot_at").agg(F.max(F.struct("loaded_at", "active")).alias("x")).select("memory_id", "snapshot_at", F.col("x.active").cast("double").alias("useful"))
    return U.moving_average(r, ["memory_id"], ["snapshot_at"], "useful", 0.15, 0.5).select("memory_id", F.round("average", 6).alias("utility"))


QUERIES = {
    f.__name__: f
    for f in (
        expired_memories, within_capacity, index_changes, active_index, access_rights, erased_facts, key_rotation, replica_reads, operation_report, invariants, derived_lineage, quarantined_support, utility_feedback,
    )
}

_TS = f"TIMESTAMPTZ '{NOW}+00'"
_HALF = "CASE lower(trim(kind)) " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in C.HALF_LIFE_DAYS.items()) + f" ELSE {C.DEFAULT_HALF_LIFE}e0 END"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY snapshot_at DESC, loaded_at DESC NULLS LAST, {tie} DESC NULLS LAST) AS rn FROM memory_records WHERE snapshot_at IS NOT NULL AND memory_id IS NOT NULL) WHERE rn = 1)"
_DAYS = f"greatest(0.0e0, (epoch_us({_TS}) - epoch_us(updated_at)) / 86400000000.0e0)"
_BROKEN = lambda rule, table, cond: f"SELECT '{rule}' AS rule, count(*) AS rows, count(*) FILTER ({cond}) AS broken FROM {table}"
_TIMES = "valid_from IS NOT NULL AND valid_to IS NOT NULL AND valid_to <= valid_from"
_BLANK = lambda c: f"coalesce(trim({c}) = '', true)"
SQL = {
    "expired_memories": f"SELECT memory_id, kind FROM memories WHERE memory_id IS NOT NULL AND NOT coalesce(pinned, false) AND epoch_us(created_at) + CAST(2.0e0 * {_HALF} * 86400000000 AS BIGINT) <= epoch_us({_TS})",
    "within_capacity": f"WITH s AS (SELECT memory_id, coalesce(pinned, false) AS pin, round(0.30e0 * mass + 0.25e0 * coalesce(confidence, 0.4e0) + 0.25e0 * least(1.0e0, coalesce(access_count, 0) / 10.0e0) + 0.20e0 * exp(-{_DAYS} / 90.0e0), 6) AS score FROM memories WHERE mass IS NOT NULL AND updated_at IS NOT NULL AND memory_id IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY pin DESC, score DESC, memory_id) AS rn FROM s) SELECT memory_id, score FROM r WHERE rn <= 500 OR pin",
    "index_changes": """WITH l AS (SELECT tenant_id, memory_id, snapshot_at, active, digest FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, memory_id, snapshot_at ORDER BY loaded_at DESC NULLS LAST, active DESC NULLS LAST, digest DESC) AS rn FROM memory_records WHERE snapshot_at IS NOT NULL AND memory_id IS NOT NULL AND digest IS NOT NULL) WHERE rn = 1),
s AS (SELECT snapshot_at, row_number() OVER (ORDER BY snapshot_at) AS n FROM (SELECT DISTINCT snapshot_at FROM l)), a AS (SELECT l.*, n FROM l JOIN s USING (snapshot_at) WHERE active = 1),
c AS (SELECT coalesce(x.n, y.n + 1) AS n, CASE WHEN y.n IS NULL THEN 'added' WHEN x.n IS NULL THEN 'removed' WHEN x.digest <> y.digest THEN 'changed' END AS change FROM a x FULL JOIN a y ON x.n = y.n + 1 AND x.tenant_id IS NOT DISTINCT FROM y.tenant_id AND x.memory_id = y.memory_id)
SELECT CAST(epoch(snapshot_at) AS BIGINT) AS snapshot_s, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed FROM c JOIN s USING (n) WHERE change IS NOT NULL GROUP BY snapshot_at""",
    "active_index": f"WITH s AS (SELECT memory_id FROM {_LAST.format(tie='active')} WHERE active = 1), i AS (SELECT DISTINCT tenant_id, item_id, memory_id FROM entity_items WHERE memory_id IS NOT NULL) SELECT tenant_id, count(*) AS items, count(DISTINCT memory_id) AS memories FROM i SEMI JOIN s USING (memory_id) GROUP BY tenant_id",
    "access_rights": """WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY write_id ORDER BY received_at NULLS FIRST, tenant_id NULLS FIRST, session_key NULLS FIRST, source NULLS FIRST, written_at NULLS FIRST) AS d FROM memory_writes WHERE write_id IS NOT NULL) WHERE d = 1 AND tenant_id IS NOT NULL AND session_key IS NOT NULL),
r AS (SELECT *, CASE WHEN lower(trim(source)) = 'user' THEN 'admin' WHEN lower(trim(source)) IN ('tool', 'verified_tool') THEN 'writer' ELSE 'reader' END AS role, row_number() OVER (PARTITION BY tenant_id, session_key ORDER BY written_at DESC NULLS LAST, write_id DESC) AS n FROM w) SELECT tenant_id, session_key, role, role <> 'reader' AS may_write FROM r WHERE n = 1""",
    "erased_facts": "WITH f AS (SELECT DISTINCT fact_id, memory_id, tenant_id, evidence FROM fact_frames WHERE fact_id IS NOT NULL) SELECT tenant_id, count(*) AS facts, sum(length(evidence))::BIGINT AS chars FROM f WHERE memory_id IS NULL OR memory_id NOT IN (SELECT memory_id FROM memories WHERE memory_id % 50 = 0) GROUP BY tenant_id",
    "key_rotation": "SELECT tenant_id, count(*) AS rows, count(*) AS unchanged FROM memories WHERE text IS NOT NULL AND tenant_id IS NOT NULL GROUP BY tenant_id",
    "replica_reads": """WITH n AS (SELECT n_nationkey::VARCHAR AS replica, n_nationkey % 4 AS revision, exp(-(n_nationkey % 7) * 100.0e0 / 500.0e0) / (1 + (n_nationkey % 5) * 20.0e0 / 100.0e0) AS ease, n_nationkey % 6 <> 0 AS healthy FROM nation), k AS (SELECT DISTINCT tenant_id FROM memories WHERE tenant_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ('0x' || substr(sha256(tenant_id || ':' || replica), 1, 15))::BIGINT DESC, replica) AS place FROM k, n), t AS (SELECT *, max(revision) OVER (PARTITION BY tenant_id) AS newest, row_number() OVER (PARTITION BY tenant_id ORDER BY healthy DESC, revision DESC, round(ease, 9) DESC, replica) AS best FROM p WHERE place <= 3)
SELECT tenant_id, max(replica) FILTER (best = 1 AND healthy) AS reader, max(newest) AS revision, coalesce(string_agg(replica, ',' ORDER BY replica) FILTER (revision < newest), '') AS stale FROM t GROUP BY tenant_id""",
    "operation_report": "SELECT event_type AS operation, count(*) AS samples, count(*) FILTER (value < 200) AS successes, round(avg(value), 4) AS mean, round(max(value), 4) AS most, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0e0, 4) AS hours, count(*) >= 1000 AND (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0e0 >= 168 AND count(*) FILTER (value < 200) >= 0.99e0 * count(*) AS long_running FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY event_type",
    "invariants": " UNION ALL ".join([
        _BROKEN("mass lies in [0, 1]", "memories", "NOT mass BETWEEN 0 AND 1"), _BROKEN("confidence lies in [0, 1]", "memories", "NOT confidence BETWEEN 0 AND 1"), _BROKEN("updates follow creation", "memories", "updated_at < created_at"),
        _BROKEN("facts end after they begin", "fact_frames", _TIMES), _BROKEN("relations end after they begin", "entity_relations", _TIMES), _BROKEN("facts have a confidence in [0, 1]", "fact_frames", "NOT confidence BETWEEN 0 AND 1"),
        _BROKEN("relations name both ends", "entity_relations", f"{_BLANK('subject')} OR {_BLANK('predicate')} OR {_BLANK('object_value')}"),
        "SELECT 'facts belong to a memory', count(*), count(*) FROM fact_frames WHERE memory_id IS NOT NULL AND memory_id NOT IN (SELECT memory_id FROM memories WHERE memory_id IS NOT NULL)",
        "SELECT 'memories come from a write', count(*), count(*) FROM memories WHERE write_id IS NOT NULL AND write_id NOT IN (SELECT write_id FROM memory_writes WHERE write_id IS NOT NULL)",
    ]),
    "derived_lineage": f"WITH i AS (SELECT DISTINCT scope, name, memory_id FROM entity_items WHERE name IS NOT NULL AND memory_id IS NOT NULL AND scope IS NOT NULL), g AS (SELECT memory_id FROM {_LAST.format(tie='lower(trim(state))')} WHERE lower(trim(state)) IN ('archived', 'invalidated')) SELECT scope, name, count(*) AS sources, count(*) >= 2 AND bool_and(memory_id IN (SELECT memory_id FROM memories WHERE memory_id IS NOT NULL)) AS valid, bool_or(memory_id IN (SELECT memory_id FROM g)) AS stale FROM i GROUP BY ALL",
    "quarantined_support": "WITH f AS (SELECT DISTINCT fact_id, scope, subject, predicate, lower(trim(object_value)) AS v, memory_id, confidence FROM fact_frames WHERE subject IS NOT NULL AND object_value IS NOT NULL AND scope IS NOT NULL AND confidence IS NOT NULL AND fact_id IS NOT NULL AND predicate IS NOT NULL), g AS (SELECT scope, subject, predicate, v, count(DISTINCT memory_id) AS n FROM f GROUP BY ALL) SELECT DISTINCT fact_id, round(CASE WHEN n >= 2 THEN confidence ELSE least(confidence, 0.45) END, 6) AS confidence FROM f JOIN g USING (scope, subject, predicate, v)",
    "utility_feedback": "WITH r AS (SELECT memory_id, snapshot_at, active::DOUBLE AS u FROM (SELECT *, row_number() OVER (PARTITION BY memory_id, snapshot_at ORDER BY loaded_at DESC NULLS LAST, active DESC) AS rn FROM memory_records WHERE snapshot_at IS NOT NULL AND memory_id IS NOT NULL AND active IS NOT NULL) WHERE rn = 1), n AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY snapshot_at DESC) - 1 AS back, count(*) OVER (PARTITION BY memory_id) AS c FROM r) SELECT memory_id, round(0.5e0 * pow(0.85e0, max(c)) + sum(0.15e0 * pow(0.85e0, back) * u), 6) AS utility FROM n GROUP BY memory_id",
}
