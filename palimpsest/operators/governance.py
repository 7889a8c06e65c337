"""Access, placement, quotas, idempotency and integrity."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of classifications; unknown ones rank highest.
CLASSIFICATION = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}


def level(classification: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in CLASSIFICATION.items():
        out = out.when(classification == k, F.lit(v))
    return out.otherwise(F.lit(3))


def allowed(rows: DataFrame, policies: DataFrame, scope: str, classification: str, action: str) -> DataFrame:
    """Rows x principals that may act: action listed, scope listed (an empty list is all), classification low enough.

    A null classification is internal. Policies are few and have one row per principal; AQE decides how to join them.
    """
    ok = F.array_contains("actions", F.lit(action)) & ((F.size("allowed_scopes") == 0) | F.array_contains("allowed_scopes", F.coalesce(F.col(scope), F.lit(""))))
    return rows.join(policies, ok & (level(F.coalesce(F.col(classification), F.lit("internal"))) <= level(F.col("max_classification"))))


def hash_force(key: Column, replica: Column) -> Column:
    """The first 15 hexadecimal digits of a digest of key and replica, as a number: the replica's pull on the key."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key, replica), 256), 1, 15), 16, 10).cast("long")


def rendezvous(keys: DataFrame, key: str, replicas: list[str], copies: int) -> DataFrame:
    """(key, replica, place): the ``copies`` replicas that pull a key most; only moves of a lost replica's keys follow a change."""
    each = keys.select(key, F.explode(F.array(*[F.lit(r) for r in replicas])).alias("replica")).withColumn("_f", hash_force(F.col(key), F.col("replica")))
    w = Window.partitionBy(key).orderBy(F.col("_f").desc(), "replica")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= copies).select(key, "replica", "place")


def hash_split(key: Column, percent: int) -> Column:
    bucket = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < percent, "dev").otherwise("holdout")


def sliding_counts(df: DataFrame, keys: list[str], at: str, seconds: int) -> Column:
    """Events of the same keys within the last ``seconds``, the row itself included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at))).rangeBetween(-seconds * 1_000_000, 0)
    return F.count(F.lit(1)).over(w)


def replays(df: DataFrame, key: str, payload: Column, order: list[str]) -> DataFrame:
    """(key, deliveries, conflict): keys delivered more than once, and whether their payloads differ; nulls compare as equal."""
    g = df.select(key, F.coalesce(F.sha2(payload, 256), F.lit("")).alias("_h")).groupBy(key)
    return g.agg(F.count(F.lit(1)).alias("deliveries"), (F.min("_h") != F.max("_h")).alias("conflict")).where("deliveries > 1")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 from two rounds of sha2, so that blind index terms are made in the JVM."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad), bytes(b ^ 0x5C for b in pad)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def chained_digests(df: DataFrame, group: str, at: str, content: Column) -> DataFrame:
    """(group, day, digest, chain): digest of each day's rows, and the chain of digests from the first day on.

    The digests of a day's rows are combined in 256 parts by their first byte, sorted within each, and the parts in
    order, so that no cell holds a whole day. The chain is one fold over the days of a group, one string per day.
    """
    rows = df.select(group, F.to_date(at).alias("day"), F.sha2(content, 256).alias("h")).where("day is not null and h is not null")
    parts = rows.groupBy(group, "day", F.left("h", F.lit(2)).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    sorted_by = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v])
    days = parts.groupBy(group, "day").agg(F.sha2(F.array_join(sorted_by("p", "d"), ""), 256).alias("digest"))
    whole = days.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("day", "digest"))).alias("l"))
    empty = F.array().cast("array<string>")
    chain = F.aggregate("l", empty, lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x["digest"]), 256))))
    return whole.withColumn("c", chain).select(group, F.inline(F.arrays_zip("l", "c"))).select(group, "l.day", "l.digest", F.col("c").alias("chain"))


def _tenant_key(tenant: Column, master: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{master}|"), tenant), 256))


def sealed(text: Column, tenant: Column, master: str) -> Column:
    """AES-GCM under a key derived per tenant; the tenant is authenticated with it. Null stays null."""
    return F.aes_encrypt(text, _tenant_key(tenant, master), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), tenant)


def opened(data: Column, tenant: Column, master: str) -> Column:
    return F.aes_decrypt(data, _tenant_key(tenant, master), F.lit("GCM"), F.lit("DEFAULT"), tenant).cast("string")
