"""Upkeep of stored memories: expiry, capacity, index changes, erasure, rights, replicas, reports, lineage, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.governance import rendezvous

# Roles from the least on.
ROLES = ["reader", "writer", "admin"]


def expired(df: DataFrame, ends: Column, now: Column) -> DataFrame:
    """Rows whose end has come; a null end never comes."""
    return df.where(ends <= now)


def keep_best(df: DataFrame, id_col: str, score: Column, capacity: int) -> DataFrame:
    """The rows that stay: all pinned ones, which come first, and the best others up to the capacity; ties by id.

    The best rows are found by a top-k of each task before one small merge, so nothing but them meets in one task.
    """
    rows = df.withColumn("_s", F.round(score, 6)).withColumn("_pin", F.coalesce(F.col("pinned"), F.lit(False)))
    pinned = rows.where("_pin")
    room = max(0, capacity - pinned.count())
    best = rows.where("not _pin").orderBy(F.col("_s").desc(), id_col).limit(room)
    return pinned.unionByName(best).drop("_pin")


def snapshot_changes(df: DataFrame, keys: list[str], snap: str, digest: str, active: Column) -> DataFrame:
    """(keys, snap, change): rows an index adds, changes or removes at each snapshot against the one before it.

    One row per key and snapshot; inactive rows are not in the index. A key missing in a snapshot leaves the index then;
    snapshots are numbered by a small table, keys are compared along their own rows, so no snapshots are joined.
    """
    rows = df.where(active & F.col(snap).isNotNull() & F.col(digest).isNotNull()).select(*keys, snap, F.col(digest).alias("_d"))
    order = df.where(F.col(snap).isNotNull()).select(snap).distinct().withColumn("_n", F.row_number().over(Window.orderBy(snap)))  # one row per snapshot
    rows = rows.join(F.broadcast(order), snap)
    by = Window.partitionBy(*keys).orderBy("_n")
    before, after = F.lag("_n").over(by), F.lead("_n").over(by)
    same = before == F.col("_n") - 1
    rows = rows.withColumns({"_in": F.when(same & (F.lag("_d").over(by) != F.col("_d")), "changed").when(F.coalesce(~same, F.lit(True)), "added"), "_out": F.when(F.coalesce(after != F.col("_n") + 1, F.lit(True)), F.col("_n") + 1)})
    comes = rows.where("_in is not null").select(*keys, "_n", F.col("_in").alias("change"))
    goes = rows.where("_out is not null").select(*keys, F.col("_out").alias("_n"), F.lit("removed").alias("change"))
    return comes.unionByName(goes).join(F.broadcast(order), "_n").select(*keys, snap, "change")


def only_active(df: DataFrame, active: DataFrame, key: str) -> DataFrame:
    return df.join(active.select(key).distinct(), key, "left_semi")


def erase(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows without those of the keys that are gone; rows of no key stay."""
    return df.join(gone.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def dangling(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is set but not known."""
    return df.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")


def latest_grants(df: DataFrame, keys: list[str], role: str, order: list[str]) -> DataFrame:
    """The last grant of each (tenant, principal)."""
    return df.groupBy(*keys).agg(F.max_by(role, F.struct(*order)).alias(role))


def reaches(role: Column, least: str) -> Column:
    """Whether a role is the least one or a higher one; unknown roles reach nothing."""
    return F.coalesce(role.isin(ROLES[ROLES.index(least) :]), F.lit(False))


def replica_reads(keys: DataFrame, key: str, replicas: DataFrame, copies: int = 3) -> DataFrame:
    """(key, reader, revision, stale): of the replicas that hold a key, the healthy one to read and those to repair.

    The newest revision comes first, then low lag and latency, then the id; stale replicas have an older revision than
    the newest. Without a healthy replica the reader is null. ``replicas`` has replica, revision, lag_ms, latency_ms and
    healthy, one row each.
    """
    p = rendezvous(keys, key, [r.replica for r in replicas.select("replica").collect()], copies).join(F.broadcast(replicas), "replica")
    ease = F.round(F.exp(-F.col("lag_ms") / 500.0) / (1.0 + F.col("latency_ms") / 100.0), 9)
    newest = F.max("revision").over(Window.partitionBy(key))
    p = p.withColumn("_newest", newest)
    first = F.min(F.when(F.col("healthy"), F.struct((-F.col("revision")).alias("r"), (-ease).alias("e"), "replica"))).alias("b")
    g = p.groupBy(key).agg(first, F.max("_newest").alias("revision"), F.array_sort(F.collect_list(F.when(F.col("revision") < F.col("_newest"), F.col("replica")))).alias("stale"))
    return g.select(key, F.col("b.replica").alias("reader"), "revision", "stale")


def operation_report(df: DataFrame, operation: str, at: str, took: Column, good: Column) -> DataFrame:
    """(operation, samples, successes, mean, most, hours, long_running), one row per operation."""
    hours = (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))) / 3_600_000_000.0
    g = df.groupBy(F.col(operation).alias("operation")).agg(F.count(F.lit(1)).alias("samples"), F.count_if(good).alias("successes"), F.avg(took).alias("mean"), F.max(took).alias("most"), hours.alias("hours"))
    return g.withColumn("long_running", (F.col("samples") >= 1000) & (F.col("hours") >= 168) & (F.col("successes") >= 0.99 * F.col("samples")))


def broken(df: DataFrame, rule: str, bad: Column) -> DataFrame:
    """(rule, rows, broken): one row; a rule that gives null for a row holds there."""
    return df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("broken"))


def lineage(df: DataFrame, keys: list[str], source: str, known: DataFrame, gone: DataFrame) -> DataFrame:
    """(keys, sources, valid, stale) of derived records: valid with two sources or more that are all known, stale if one is gone."""
    flag = lambda t, n: t.where(F.col(source).isNotNull()).select(source).distinct().withColumn(n, F.lit(True))
    j = df.join(flag(known, "_k"), source, "left").join(flag(gone, "_g"), source, "left")
    g = j.groupBy(*keys).agg(F.countDistinct(source).alias("sources"), F.bool_and(F.coalesce("_k", F.lit(False))).alias("_all"), F.bool_or(F.coalesce("_g", F.lit(False))).alias("stale"))
    return g.withColumn("valid", (F.col("sources") >= 2) & F.col("_all")).drop("_all")


def capped_until_supported(df: DataFrame, keys: list[str], source: str, score: str, cap: float, least: int = 2) -> DataFrame:
    """Rows with their score capped unless so many different sources tell the same; repeats of one source do not count."""
    n = df.groupBy(*keys).agg(F.countDistinct(source).alias("_n"))
    return df.join(n, keys).withColumn(score, F.when(F.col("_n") >= least, F.col(score)).otherwise(F.least(F.col(score), F.lit(cap)))).drop("_n")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float, start: float) -> DataFrame:
    """(keys, average): exponential moving average of the values of a key in order, from ``start``.

    The fold is linear, so it is a sum of values weighed by how many come after them: no row waits for another.
    """
    by = Window.partitionBy(*keys)
    back = F.row_number().over(by.orderBy(*[F.col(c).desc() for c in order])) - 1
    rows = df.withColumn("_w", F.pow(F.lit(1 - rate), back))
    return rows.groupBy(*keys).agg((start * F.pow(F.lit(1 - rate), F.count(F.lit(1))) + F.sum(rate * F.col("_w") * F.col(value))).alias("average"))
