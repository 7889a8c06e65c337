"""Dense vectors: cosine, centroids, sign hashing candidates, late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 where lengths differ or a vector is missing."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(s, F.lit(0.0))).otherwise(F.lit(0.0))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, v) packed into about equal blocks of at most a few times ``size`` rows, by hash of the id."""
    n = max(1, -(-rows.count() // size))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("_b")).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vs"))
    return packed.drop("_b")


def exact_neighbours(vectors: DataFrame, id_col: str, vec: str, every: int, k: int, block: int = 2048) -> DataFrame:
    """(query, id, score, rank): the k best rows of all for each row whose id is divisible by ``every``.

    The stated query set meets all rows block by block: both are packed into blocks of bounded size, each pair of
    blocks is one matrix product in some task, and leaves k rows per query for the window that merges them. Nothing
    goes through the driver. Null and empty vectors have no neighbours; ties go to the lower id.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    pairs = _blocks(rows.where(F.col("id") % every == 0), block, "q").crossJoin(_blocks(rows, block, "r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qid, qv, ids, v in b[["q_ids", "q_vs", "r_ids", "r_vs"]].itertuples(index=False, name=None):
                s = np.round(np.stack(qv).astype(np.float64) @ np.stack(v).astype(np.float64).T, 6)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, : k + 1]
                yield pd.DataFrame({"query": np.repeat(qid, order.shape[1]), "id": np.asarray(ids)[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    found = pairs.mapInPandas(run, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.where("query <> id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_centroids(vectors: DataFrame, group: str, vec: str, weight: Column) -> DataFrame:
    """(group, dim, value): unit-length weighted mean of each group, one row per dimension."""
    parts = vectors.select(group, weight.alias("_w"), F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.sum(F.col("x").cast("double") * F.col("_w")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(group)))
    return parts.select(group, "dim", F.when(norm > 0, F.col("s") / norm).otherwise(F.lit(0.0)).alias("value"))


def sign_planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim), dtype=np.float32)


def sign_signatures(vectors: DataFrame, id_col: str, vec: str, dim: int, tables: int = 32, bits: int = 8, seed: int = 370031) -> DataFrame:
    """(id, table, signature): random-hyperplane signatures; every row is indexed."""
    planes = sign_planes(dim, tables, bits, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(np.float32)
                sig = ((np.einsum("tbd,nd->ntb", planes, m) >= 0) << np.arange(bits)).sum(2)
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), tables), "table": np.tile(np.arange(tables), len(b)).astype("int32"), "signature": sig.ravel().astype("int64")})

    rows = vectors.where(F.size(vec) == dim).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    return rows.mapInPandas(run, "id long, table int, signature long")


def sign_neighbours(vectors: DataFrame, id_col: str, vec: str, dim: int, every: int, k: int, probes: int = 1, tables: int = 32, bits: int = 8) -> DataFrame:
    """(query, id, score, rank): neighbours found through a bucket in common, with signatures up to ``probes`` bits off.

    The probes (all single flips for 1) belong to the query side only; the join is on (table, signature), exact cosine
    ranks what it finds. Tables and bits suit neighbours at a cosine of 0.3, where few signatures agree in many bits:
    about two thirds of unlike rows are met as well. Closer neighbours need fewer tables of more bits.
    """
    sig = sign_signatures(vectors, id_col, vec, dim, tables, bits)
    q = sig.where(F.col("id") % every == 0)
    flips = F.array(F.lit(0).cast("long"), *([F.lit(1 << i).cast("long") for i in range(bits)] if probes else []))
    q = q.select(F.col("id").alias("query"), "table", F.explode(F.transform(flips, lambda f: F.col("signature").bitwiseXOR(f))).alias("signature"))
    pairs = sig.join(q, ["table", "signature"]).where("id <> query").select("query", "id").distinct()
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    scored = pairs.join(v, "id").join(v.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query").withColumn("score", F.round(dot(F.col("v"), F.col("qv")), 6))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored.select("query", "id", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def max_sim(pairs: DataFrame, query: str, doc: str) -> Column:
    """Late interaction of two arrays of token vectors: for each query token its best document token, summed."""
    return F.aggregate(F.transform(F.col(query), lambda q: F.array_max(F.transform(F.col(doc), lambda d: dot(q, d)))), F.lit(0.0), lambda a, x: a + x)


#: Centroids go to the executors as one array if they have no more numbers than this (16 MB); more are joined by blocks.
MOST_CENTROID_NUMBERS = 2_000_000


def centroid_table(rows: DataFrame, cluster: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(cluster, centre): unit centroid of each cluster as one array."""
    c = weighted_centroids(rows, cluster, vector, F.lit(1.0) if weight is None else weight)
    return c.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centre"))


def against_centroids(rows: DataFrame, vector: str, centres: DataFrame, name: str) -> DataFrame:
    """Every row with every centroid as (columns of rows but the vector, name, score); no join where the centroids are few.

    ``centres`` has the cluster and its centre. Up to MOST_CENTROID_NUMBERS numbers they are one literal of the plan, so
    that rows are only projected; beyond, rows and centroids meet in blocks of 256 centroids.
    """
    cluster = centres.columns[0]
    centres = materialize(centres, "centroids")
    size = centres.agg(F.sum(F.size("centre"))).first()[0] or 0
    keep = [c for c in rows.columns if c != vector]
    score = lambda c: F.round(dot(F.col(vector), c), 5)
    if size <= MOST_CENTROID_NUMBERS:
        found = centres.orderBy(cluster).collect()
        kind = centres.schema[cluster].dataType
        if not found:
            return rows.select(*keep, F.lit(None).cast(kind).alias(name), F.lit(None).cast("double").alias("score")).limit(0)
        pairs = [F.struct(F.lit(r[0]).cast(kind).alias(name), score(F.lit([float(x) for x in r[1]])).alias("score")) for r in found]
        return rows.select(*keep, F.inline(F.array(*pairs)))
    block = F.pmod(F.xxhash64(cluster), F.lit(-(-size // 65536)))
    blocks = centres.groupBy(block.alias("_b")).agg(F.collect_list(F.struct(F.col(cluster).alias(name), F.col("centre"))).alias("_c"))
    wide = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size // 65536) - 1).cast("long")))).join(blocks, "_b")
    return wide.select(*keep, F.inline(F.transform("_c", lambda x: F.struct(x[name].alias(name), score(x["centre"]).alias("score")))))


def best_centroid(rows: DataFrame, vector: str, centres: DataFrame, name: str) -> DataFrame:
    """(columns of rows but the vector, name, score): the best centroid of each row, ties to the lesser one."""
    keep = [c for c in rows.columns if c != vector]
    all_of = against_centroids(rows, vector, centres, name)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(name))).alias("_b")
    return all_of.groupBy(*keep).agg(best).select(*keep, f"_b.{name}", (-F.col("_b.s")).alias("score"))
