"""Lexical retrieval: BM25 over term tables, visible prefixes, rank fusion and score normalization.

Every stage is a join or an aggregation keyed by term or document; a term that a third of the documents hold is joined
to few query terms only, and postings of terms that no query has never leave the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import materialize

K1, B = 1.35, 0.72


#: Query terms up to this number are a hash set within the scan of the documents; more are joined to all terms.
SET_TERMS = 5_000


def bm25_scores(docs: DataFrame, id_col: str, terms: Column, queries: DataFrame, query_id: str, query_terms: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) of all documents that share a term with a query.

    Document frequency, mean length and number of documents count all rows of ``docs``, empty ones included; ids are
    unique. Texts are read and cut into terms once: of each document only its length and its query terms leave that stage.
    """
    q = materialize(queries.select(query_id, F.explode(query_terms).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf")), "bm25_query")
    wanted = [r.term for r in q.select("term").distinct().limit(SET_TERMS + 1).collect()]
    if len(wanted) <= SET_TERMS:
        # a document is cut into terms once; only its length and its hits leave the scan
        cut = T._once(terms, lambda t: F.struct(F.greatest(F.size(t), F.lit(0)).alias("dl"), F.filter(t, lambda w: w.isin(wanted)).alias("hits")))
        cut = materialize(docs.select(F.col(id_col), cut.alias("x")).select(id_col, F.coalesce("x.dl", F.lit(0)).alias("dl"), "x.hits"), "bm25_cut")
        lengths = cut.select(id_col, "dl")
        hits = cut.select(id_col, F.explode("hits").alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        uses = docs.select(F.col(id_col), F.explode_outer(terms).alias("term")).join(q.select("term").distinct().withColumn("hit", F.col("term")), "term", "left")
        uses = materialize(uses.groupBy(id_col, "hit").agg(F.count("term").alias("tf")), "bm25_uses")
        lengths = uses.groupBy(id_col).agg(F.sum("tf").alias("dl"))
        hits = uses.where("hit is not null").withColumnRenamed("hit", "term")
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(lengths, id_col).join(df, "term").join(q, "term").crossJoin(F.broadcast(totals))  # totals is one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1.0 - b + b * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * norm)
    return scored.groupBy(query_id, id_col).agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, query_id: str, id_col: str, score: str, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by rounded score, ties by id; row_number <= k is pushed into a group limit."""
    w = Window.partitionBy(query_id).orderBy(F.col("_s").desc(), F.col(id_col))
    rows = scores.withColumn("_s", F.round(score, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.select(query_id, id_col, F.col("_s").alias(score), "rank")


def reciprocal_rank(rank: Column, constant: float = 60.0) -> Column:
    return 1.0 / (constant + rank)


def unit_max(value: str, *partition: str) -> Column:
    """Value over the greatest of its partition; 0 where none is positive."""
    top = F.max(value).over(Window.partitionBy(*partition))
    return F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0))


def unit_min_max(value: str, *partition: str) -> Column:
    """Value between the least and greatest of its partition; 0 where all are equal."""
    w = Window.partitionBy(*partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def fuse_ranks(rankings: list[tuple[DataFrame, float]], query_id: str, id_col: str) -> DataFrame:
    """Weighted sum of reciprocal ranks of several rankings with columns query, id and rank."""
    parts = [r.select(query_id, id_col, (reciprocal_rank(F.col("rank")) * w).alias("_p")) for r, w in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(query_id, id_col).agg(F.sum("_p").alias("score"))


def neighbour_max(value: str, group: str, order: str) -> Column:
    """Greatest value of a row and the rows next to it in its group."""
    return F.max(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(-1, 1))


def positions(df: DataFrame, group: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds position (from 0) of a row in the order of its group, and the group's size.

    ``bucket`` grows with the order: rows are numbered inside (group, bucket) and moved by the sizes of the buckets before,
    so a group of a third of all rows is not sorted in one task.
    """
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(group).orderBy("_b")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy(group))})
    s = sizes.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_before", "size")
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1
    numbered = rows.withColumn("_i", inside).join(s, F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_c")))
    return numbered.withColumn("position", F.col("_before") + F.col("_i")).drop("_b", "_i", "_g", "_c", "_before")


def rare_bridge(uses: DataFrame, seeds: DataFrame, query_id: str, id_col: str, least: int = 2, most: int = 12, terms: int = 64) -> DataFrame:
    """(query, id, bridge): rows that the rare terms of a question's best rows lead to, over the question's greatest.

    ``uses`` has id, term and tf of all rows, ``seeds`` the ranked seeds of each question (query, id, rank) and its own
    terms (own, an array). A term of four letters or more that ``least`` to ``most`` rows hold leads on, the ``terms``
    rarest of each seed; each row gets idf x min(2, tf) / rank of the seed. Frequent terms never enter, so the join is
    bounded by ``most``.
    """
    n = uses.agg(F.countDistinct(id_col).alias("n"))
    df = uses.groupBy("term").agg(F.countDistinct(id_col).alias("df")).where(F.col("df").between(least, most))
    rare = uses.join(df, "term").crossJoin(F.broadcast(n))  # one row
    rare = rare.withColumn("idf", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select(id_col, "term", "tf", "idf")
    led = seeds.join(rare, id_col).where((F.length("term") >= 4) & ~F.array_contains("own", F.col("term")))
    w = Window.partitionBy(query_id, id_col).orderBy(F.col("idf").desc(), F.col("term").desc())
    led = led.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= terms).select(query_id, F.col(id_col).alias("_seed"), "rank", "term")
    to = led.join(rare, "term").where(F.col(id_col) != F.col("_seed"))
    s = to.groupBy(query_id, id_col).agg(F.sum(F.col("idf") * F.least(F.lit(2), F.col("tf")) / F.col("rank")).alias("s"))
    return s.select(query_id, id_col, (F.col("s") / F.max("s").over(Window.partitionBy(query_id))).alias("bridge"))
