"""Filling token sequences of fixed capacity with documents, balanced by cost.

The cost of a sequence is linear in its tokens plus quadratic in the length of each document in it (attention stays
within a document). Documents, longest first, go to the sequence of the lowest cost that still has room. Packing is
done in shards of about shard_tokens tokens, drawn by hash, so that tasks stay bounded however large the corpus is. A
shard has thousands of sequences, so its last ones hardly weigh: the README gives the fill against one single shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialize


@dataclass(frozen=True)
class PackingConfig:
    """quadratic: cost of a squared token against that of a token (1 / (6 x width) for a model of width 1024)."""

    quadratic: float = 1 / 6144
    shard_tokens: int = 2_000_000


def pack(sizes: np.ndarray, capacity: int, quadratic: float) -> np.ndarray:
    """Sequence number of each piece (0 < size <= capacity); equal sizes keep their order.

    Sequences with room for the size at hand stand in a heap by cost, the others wait in a heap by room until the sizes,
    which descend, have come down to it. So each piece costs a few steps of a heap.
    """
    out = np.full(len(sizes), -1, np.int64)
    opened = -(-int(sizes.sum()) // capacity) if len(sizes) else 0
    room, ready, waiting = [capacity] * opened, [(0.0, j) for j in range(opened)], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        while waiting and -waiting[0][0] >= size:
            _, cost, j = heapq.heappop(waiting)
            heapq.heappush(ready, (cost, j))
        if ready:
            cost, j = heapq.heappop(ready)
        else:
            cost, j = 0.0, len(room)
            room.append(capacity)
        out[i] = j
        room[j] -= size
        cost += size + quadratic * size * size
        if room[j] >= size:
            heapq.heappush(ready, (cost, j))
        elif room[j]:
            heapq.heappush(waiting, (-room[j], cost, j))
    return out


def pack_documents(sized: DataFrame, containers: DataFrame, cfg: PackingConfig = PackingConfig()) -> DataFrame:
    """(container, sequence_id, doc_id, piece, first_token, n_tokens): every document in each kind of container.

    ``sized`` has doc_id and n_tokens, ``containers`` the name and capacity_tokens of each kind. A document is whole in
    one sequence unless it exceeds the capacity: then it is cut into full sequences of its own and a rest, which is
    packed. Documents without tokens, null ids and null or non-positive capacities take no space and do not come out.
    Repeated rows of a document count once. Sequence ids are unique within a container.
    """
    sized = materialize(sized.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n_tokens").dropDuplicates(["doc_id"]), "packing_sizes")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // cfg.shard_tokens))
    kinds = containers.where(F.col("capacity_tokens") > 0).select("container", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    each = sized.crossJoin(F.broadcast(kinds))  # a few kinds of container for each document
    full = F.floor(F.col("n_tokens") / F.col("capacity"))
    whole = (
        each.where("n_tokens > capacity")
        .select("container", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
        .select("container", F.concat_ws("-", F.lit("d"), "doc_id", "piece").alias("sequence_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"))
    )
    cut = F.col("n_tokens") > F.col("capacity")
    rest = each.select(
        "container", "capacity", "doc_id", F.when(cut, full).otherwise(F.lit(0)).cast("long").alias("piece"), F.when(cut, F.pmod("n_tokens", "capacity")).otherwise(F.col("n_tokens")).alias("size")
    ).where("size > 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(int(shards))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        at = pack(pdf["size"].to_numpy(np.int64), capacity, cfg.quadratic)
        return pd.DataFrame(
            {"container": pdf["container"], "sequence_id": [f"s-{shard}-{j}" for j in at], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "first_token": pdf["piece"] * capacity, "n_tokens": pdf["size"]}
        )

    schema = "container string, sequence_id string, doc_id long, piece long, first_token long, n_tokens long"
    return rest.groupBy("container", "capacity", "shard").applyInPandas(run, schema).unionByName(whole)


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity_tokens, sequences, tokens, fill): how well each kind of container is used."""
    by = packed.groupBy("container").agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("n_tokens").alias("tokens"))
    kinds = containers.select("container", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    return by.join(F.broadcast(kinds), "container").select("container", "capacity_tokens", "sequences", "tokens", (F.col("tokens") / (F.col("sequences") * F.col("capacity_tokens"))).alias("fill"))
