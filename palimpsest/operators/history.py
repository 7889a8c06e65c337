"""Versioned history of changing attributes, by Merkle comparison of successive snapshots.

The rows of each snapshot (or update period) are hashed into key buckets, the buckets into a tree. The tree of a
snapshot is compared with that of the snapshot before it from the root down, and only differing branches are
descended. The rows of equal leaves repeat what is known and are left out; the rows of differing leaves are diffed
and their new versions appended. The diff works on (key, chunk of time) groups that are stitched through one small
summary row per key and chunk, so that a hot key is spread over its chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize

FANOUT_BITS = 6
#: Keys that share a leaf, about; leaves must hold few keys, or each differs in every snapshot and nothing is pruned.
KEYS_PER_LEAF = 16


def leaf_bits_for(rows: DataFrame, keys: list[str]) -> int:
    """Bits of the leaf numbers of a tree over these keys, from an approximate count of the keys."""
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*keys), 0.05)).first()[0] or 0
    return max(1, (n // KEYS_PER_LEAF).bit_length())


def _mark(c: str) -> Column:
    """A value, or the sign of an ended version, as a string that is never null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("x"))


def merkle_changed_leaves(rows: DataFrame, keys: list[str], snap: str, value: str, leaf_bits: int) -> DataFrame:
    """(snap, leaf) whose digest differs from that of the snapshot before it.

    ``rows`` has the columns leaf and _chunk and is already partitioned by them, so that its groups need no shuffle. A
    key with several values in one snapshot makes its leaf differ always, as the order of those values matters. The
    first snapshot differs throughout. The tree is small: at most leaves x snapshots rows.
    """
    per_key = rows.groupBy("leaf", "_chunk", snap, *keys).agg(F.min(_mark(value)).alias("_lo"), F.max(_mark(value)).alias("_hi"))
    one = F.when(F.col("_lo") == F.col("_hi"), F.xxhash64(*keys, "_lo")).otherwise(F.xxhash64(*keys, F.col(snap), "_lo", "_hi"))
    level = per_key.groupBy("leaf", "_chunk", snap).agg(F.bit_xor(one).alias("digest"), F.count(F.lit(1)).alias("size"))
    level = materialize(level.select(snap, F.col("leaf").alias("node"), "digest", "size"), "merkle_leaves")
    order = materialize(level.select(snap).distinct().withColumn("_no", F.row_number().over(Window.orderBy(snap))), "merkle_order")  # one row per snapshot
    level = level.join(F.broadcast(order), snap).select("_no", "node", "digest", "size")
    levels = [level]
    for _ in range(0, leaf_bits, FANOUT_BITS):
        level = (
            level.withColumn("_mix", F.xxhash64("node", "digest", "size"))
            .groupBy("_no", F.shiftright("node", FANOUT_BITS).alias("node"))
            .agg(F.bit_xor("_mix").alias("digest"), F.sum("size").alias("size"))
        )
        levels.append(level)

    def differing(nodes: DataFrame) -> DataFrame:
        w = Window.partitionBy("node").orderBy("_no")
        same = (F.lag("_no").over(w) == F.col("_no") - 1) & (F.lag("digest").over(w) == F.col("digest")) & (F.lag("size").over(w) == F.col("size"))
        return nodes.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).select("_no", "node")

    def descend(parents: DataFrame, children: DataFrame) -> DataFrame:
        up = parents.select("_no", F.col("node").alias("_up"))
        return differing(children).withColumn("_up", F.shiftright("node", FANOUT_BITS)).join(up, ["_no", "_up"], "left_semi").select("_no", "node")

    found = reduce(descend, reversed(levels[:-1]), differing(levels[-1]))
    return materialize(found.join(F.broadcast(order), "_no").select(snap, F.col("node").alias("leaf")), "merkle_changed")


def version_history(
    df: DataFrame, keys: list[str], value: Column, at: Column, tie: Column, snap: Column, chunk: Column | None = None, pick: Column | None = None, leaf_bits: int | None = None
) -> DataFrame:
    """Rows (keys, held_value, from_at, to_at): one row per version, to_at null while it holds.

    value is null where a row ends the version that holds and starts none. Rows are ordered by ``at``, equal times by
    ``tie`` and then by value; equal successive values are one version. With ``pick``, only the row of the greatest
    pick counts of a key and time. ``snap`` names the snapshot or update period of a row and must grow with ``at``;
    ``chunk`` is snap or coarser and spreads a hot key over tasks. Without a chunk a key is one group, which suits
    keys of one row per snapshot. Rows whose ``at`` is null do not count. Null key values form a key of their own.
    Repeated rows change nothing. An empty input gives an empty result. The number of leaves follows from that of the
    keys unless leaf_bits is given.

    One shuffle by (leaf, chunk) serves the duplicates, the tree and the diff, as all of them group by more than that.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    stitched = chunk is not None
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], value.alias("_val"), at.alias("_at"), tie.alias("_tie"), snap.alias("_snap"),
        (chunk if stitched else F.lit(0)).alias("_chunk"), (pick if pick is not None else F.lit(0)).alias("_pick"),
    ).where(F.col("_at").isNotNull())
    leaf_bits = leaf_bits or leaf_bits_for(rows, names)
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64(*names), F.lit(1 << leaf_bits))).repartition("leaf", "_chunk")
    own = ["leaf", "_chunk", *names, "_snap", "_at"]
    if pick is not None:
        rows = rows.groupBy(*own).agg(F.max(F.struct("_pick", "_val", "_tie")).alias("_x")).select(*own, "_x._val", "_x._tie")
    else:
        rows = rows.groupBy(*own, "_val").agg(F.min("_tie").alias("_tie"))
    changed = merkle_changed_leaves(rows, names, "_snap", "_val", leaf_bits)
    rows = rows.join(changed, ["_snap", "leaf"], "left_semi")
    order = [F.col("_at"), F.col("_tie"), _mark("_val")]
    in_chunk = Window.partitionBy("leaf", "_chunk", *names).orderBy(*order)
    steps = rows.withColumn("_prev", F.lag(_mark("_val")).over(in_chunk))
    steps = steps.where(F.col("_prev").isNull() | (F.col("_prev") != _mark("_val")))
    steps = steps.withColumn("_rn", F.row_number().over(in_chunk)).withColumn("_next", F.lead("_at").over(in_chunk))
    out = [F.col("_val").alias("held_value"), F.col("_at").alias("from_at")]
    if not stitched:
        return steps.where(F.col("_val").isNotNull()).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *out, F.col("_next").alias("to_at"))
    first, last = F.min_by(F.struct("_at", "_next", _mark("_val").alias("m")), "_rn"), F.max_by(_mark("_val"), "_rn")
    chunks = steps.groupBy("leaf", "_chunk", *names).agg(first.alias("_f"), last.alias("_last"))
    by_key = Window.partitionBy(*names).orderBy("_chunk")
    fresh = F.coalesce(F.lag("_last").over(by_key) != F.col("_f.m"), F.lit(True))
    chunks = chunks.withColumn("_fresh", fresh).withColumn("_change", F.when(F.col("_fresh"), F.col("_f._at")).otherwise(F.col("_f._next")))
    later = by_key.rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.withColumn("_later", F.first("_change", ignorenulls=True).over(later))
    c = chunks.select(*[F.col(n).alias(f"c{n}") for n in names], F.col("_chunk").alias("c_chunk"), "_fresh", "_later")
    same = reduce(lambda a, b: a & b, [steps[n].eqNullSafe(c[f"c{n}"]) for n in names], steps["_chunk"] == c["c_chunk"])
    joined = steps.join(c, same).where(F.col("_val").isNotNull() & ((F.col("_rn") > 1) | F.col("_fresh")))
    return joined.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *out, F.coalesce("_next", "_later").alias("to_at"))


def state_history(records: DataFrame) -> DataFrame:
    """Versions of the state of each memory from periodic snapshots (memory_records).

    Of several rows of one memory and snapshot the one loaded last counts (a null load time is the earliest, ties go to
    the greater state), among those with a state. A missing snapshot changes nothing. Case and outer blanks of a state
    are ignored; a blank state is none.
    """
    state = F.lower(F.trim("state"))
    kept = records.select("tenant_id", F.col("memory_id").cast("string").alias("entity"), "snapshot_at", "loaded_at", state.alias("state")).where(
        F.col("memory_id").isNotNull() & (F.col("state") != "")
    )
    at = F.col("snapshot_at")
    return version_history(kept, ["tenant_id", "entity"], F.col("state"), at, F.lit(0), at, pick=F.struct("loaded_at", "state"))


def fact_history(facts: DataFrame) -> DataFrame:
    """Versions of the object value of each (tenant, scope, subject, predicate) from out-of-order fact rows.

    Rows without subject, object value or assertion time do not count; a row of negative polarity ends the version
    that holds. Equal assertion times are ordered by fact_id. Case and outer blanks of a value are ignored.
    """
    month = F.date_trunc("month", F.col("asserted_at"))
    kept = facts.select(
        "tenant_id", "scope", "subject", "predicate", "fact_id", "asserted_at", F.when(F.coalesce(F.col("polarity"), F.lit(1)) >= 0, F.lower(F.trim("object_value"))).alias("val"), "object_value"
    ).where(F.col("subject").isNotNull() & F.col("object_value").isNotNull())
    return version_history(kept, ["tenant_id", "scope", "subject", "predicate"], F.col("val"), F.col("asserted_at"), F.col("fact_id"), month, month)
