"""Queries of tokenizers and lexical retrieval, with their SQL.

The subject areas are the query set (name and gloss), the documents the sources, and the labels the gold answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import lexical as L
from palimpsest.session import materialize, read_table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text", "source").where(F.col("text").isNotNull())


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "subject_areas").select("subject", F.concat_ws(" ", "subject", "gloss").alias("query"))


def retrieval_terms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.concat_ws(" ", T.retrieval_terms("text")).alias("terms"))


def character_terms(spark: SparkSession, d: str) -> DataFrame:
    t = F.explode(T.char_terms("text"))
    return _docs(spark, d).select("doc_id", t.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("doc_id").alias("documents"))


def memory_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").where("text is not null").select("memory_id", F.concat_ws(" ", T.memory_tokens("text")).alias("tokens"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25_scores(_docs(spark, d), "doc_id", T.retrieval_terms("text"), _queries(spark, d), "subject", T.retrieval_terms("query"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.top_k(_bm25(spark, d), "subject", "doc_id", "score", 10)


def char_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scores = L.bm25_scores(_docs(spark, d), "doc_id", T.char_terms("text"), _queries(spark, d), "subject", T.char_terms("query"))
    return L.top_k(scores, "subject", "doc_id", "score", 10)


def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Only documents before the middle id are visible, and only they count for the statistics."""
    docs = _docs(spark, d)
    half = docs.agg((F.max("doc_id") / 2).cast("long").alias("half"))
    visible = docs.join(F.broadcast(half), F.col("doc_id") < F.col("half")).drop("half")
    scores = L.bm25_scores(visible, "doc_id", T.retrieval_terms("text"), _queries(spark, d), "subject", T.retrieval_terms("query"))
    return L.top_k(scores, "subject", "doc_id", "score", 10)


def bm25_memory_max(spark: SparkSession, d: str) -> DataFrame:
    """The memory index's variant: own tokenizer and constants, scores over the best of the query."""
    rows = read_table(spark, d, "memories").where("text is not null").select("memory_id", "text")
    s = L.bm25_scores(rows, "memory_id", T.memory_tokens("text"), _queries(spark, d), "subject", T.memory_tokens("query"), 1.45, 0.72)
    s = s.withColumn("score", L.unit_max("score", "subject"))
    return L.top_k(s, "subject", "memory_id", "score", 10)


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks of words and of characters (weight 0.72)."""
    words = L.top_k(_bm25(spark, d), "subject", "doc_id", "score", 50)
    chars = L.top_k(L.bm25_scores(_docs(spark, d), "doc_id", T.char_terms("text"), _queries(spark, d), "subject", T.char_terms("query")), "subject", "doc_id", "score", 50)
    return L.top_k(L.fuse_ranks([(words, 1.0), (chars, 0.72)], "subject", "doc_id"), "subject", "doc_id", "score", 10, 9)


def score_norms(spark: SparkSession, d: str) -> DataFrame:
    s = L.top_k(_bm25(spark, d), "subject", "doc_id", "score", 20)
    return s.select("subject", "doc_id", F.round(L.unit_max("score", "subject"), 6).alias("over_max"), F.round(L.unit_min_max("score", "subject"), 6).alias("min_max"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Any, full and micro recall at 10 and reciprocal rank of the first gold document, over all queries."""
    gold = read_table(spark, d, "subject_labels").select("subject", "doc_id").where("subject is not null").distinct()
    scores = materialize(_bm25(spark, d).select("subject", "doc_id", F.round("score", 6).alias("score")), "recall_scores")
    found = gold.join(scores, ["subject", "doc_id"])
    hits = L.top_k(scores, "subject", "doc_id", "score", 10).join(gold, ["subject", "doc_id"], "left_semi").groupBy("subject").agg(F.count(F.lit(1)).alias("hit"))
    best = found.groupBy("subject").agg(F.max(F.struct("score", -F.col("doc_id"))).alias("b")).select("subject", F.col("b.score").alias("s"), (-F.col("b.col2")).alias("i"))
    above = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("doc_id") < F.col("i")))
    first = scores.join(F.broadcast(best), "subject").groupBy("subject").agg((F.count_if(above) + 1).alias("first"))  # best has one row per question
    per = gold.groupBy("subject").agg(F.count(F.lit(1)).alias("gold")).join(hits, "subject", "left").join(first, "subject", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.agg(
        F.count(F.lit(1)).alias("queries"), mean((F.col("hit") > 0).cast("double"), "any_at_10"), mean((F.col("hit") == F.col("gold")).cast("double"), "full_at_10"),
        F.round(F.sum("hit") / F.sum("gold"), 6).alias("micro_at_10"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"),
    )


def neighbour_flux(spark: SparkSession, d: str) -> DataFrame:
    """Mass of a memory spread to its neighbours in time within its scope, over the scope's greatest."""
    m = read_table(spark, d, "memories").where("scope is not null and mass is not null and created_at is not null").select("scope", "memory_id", "mass", F.struct("created_at", "memory_id").alias("at"))
    flux = m.withColumn("flux", L.neighbour_max("mass", "scope", "at"))
    return flux.select("scope", "memory_id", F.round(L.unit_max("flux", "scope"), 6).alias("flux"))


def entity_resonance(spark: SparkSession, d: str) -> DataFrame:
    """Share of the identifiers, numbers and names of a fact's evidence that its memory's text holds."""
    f = read_table(spark, d, "fact_frames").where("evidence is not null and memory_id is not null").select("fact_id", "memory_id", "evidence").distinct()
    m = read_table(spark, d, "memories").where("text is not null").select("memory_id", "text")
    j = f.join(m, "memory_id").groupBy("fact_id").agg(F.max(T.overlap_share(T.value_items("evidence"), T.value_items("text"))).alias("r"))
    return j.select("fact_id", F.round("r", 6).alias("resonance"))


def date_ramp(spark: SparkSession, d: str) -> DataFrame:
    """Weak recency of each document among those of its source: its position from the oldest (0) to the newest (1)."""
    docs = read_table(spark, d, "documents").where("created_at is not null and source is not null").select("source", "doc_id", "created_at")
    docs = L.positions(docs, "source", ["created_at", "doc_id"], F.to_date("created_at"))
    return docs.select("doc_id", F.round(F.col("position") / F.greatest(F.lit(1), F.col("size") - 1), 6).alias("ramp"))


def cooccurring_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that documents of a query's words share: overlap of 2 or more, df at most 0.4 N, overlap / sqrt(dfs), best 24."""
    docs = _docs(spark, d)
    terms = docs.select("doc_id", F.explode(F.array_distinct(T.content_words("text"))).alias("term"))
    n = docs.agg(F.greatest(F.lit(8.0), 0.4 * F.count(F.lit(1))).alias("cap"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    query = _queries(spark, d).select("subject", F.explode(F.array_distinct(T.content_words("query"))).alias("anchor"))
    anchored = terms.join(query, F.col("term") == F.col("anchor")).select("subject", "doc_id").distinct()
    size = anchored.groupBy("subject").agg(F.count(F.lit(1)).alias("anchors"))
    over = anchored.join(terms, "doc_id").groupBy("subject", "term").agg(F.count(F.lit(1)).alias("overlap")).where("overlap >= 2")
    own = query.select("subject", F.col("anchor").alias("term"))
    s = over.join(df, "term").join(size, "subject").crossJoin(F.broadcast(n)).where("df <= cap").join(own, ["subject", "term"], "left_anti")
    s = s.withColumn("score", F.col("overlap") / F.sqrt(F.col("anchors").cast("double") * F.col("df")))
    return L.top_k(s, "subject", "term", "score", 24)


QUERIES = {
    f.__name__: f
    for f in (retrieval_terms, character_terms, memory_tokens, bm25_topk, char_bm25_topk, bm25_prefix, bm25_memory_max, rank_fusion, score_norms, recall_at_k, neighbour_flux, entity_resonance, date_ramp, cooccurring_terms)
}

_Q = "q AS (SELECT subject, concat_ws(' ', subject, gloss) AS query FROM subject_areas)"


def _words(table: str, key: str, col: str, name: str, where: str = "true") -> str:
    return f"{name}_w AS (SELECT {key}, {T.sql_content_words(col)} AS w FROM {table} WHERE {col} IS NOT NULL AND {where}), {name} AS (SELECT {key}, {T.sql_retrieval_terms('w')} AS t FROM {name}_w)"


def _chars(table: str, key: str, col: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, {T.sql_char_terms(col)} AS t FROM {table} WHERE {col} IS NOT NULL)"


def _memory(table: str, key: str, col: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, {T.sql_memory_tokens(col)} AS t FROM {table} WHERE {col} IS NOT NULL)"


def _bm25_sql(p: str, docs: str, qs: str, key: str, k1: float = 1.35, b: float = 0.72) -> str:
    """CTEs that end in {p}s(subject, key, score) from docs(key, t) and qs(subject, t)."""
    return f"""{p}tc AS (SELECT {key}, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM {docs}) GROUP BY {key}, term),
{p}st AS (SELECT count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS avgdl FROM {docs}),
{p}df AS (SELECT term, count(*) AS df FROM {p}tc GROUP BY term),
{p}qt AS (SELECT subject, term, count(*) AS qtf FROM (SELECT subject, unnest(t) AS term FROM {qs}) GROUP BY ALL),
{p}s AS (SELECT subject, {key}, sum(qtf * ln(1.0e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * ({k1}e0 + 1.0e0) / (tf + {k1}e0 * (1.0e0 - {b}e0 + {b}e0 * dl / avgdl))) AS score
  FROM {p}tc JOIN {p}df USING (term) JOIN {p}qt USING (term), {p}st GROUP BY ALL)"""


def _top(src: str, key: str, k: int, digits: int = 6) -> str:
    return f"(SELECT subject, {key}, score, rank FROM (SELECT subject, {key}, round(score, {digits}) AS score, row_number() OVER (PARTITION BY subject ORDER BY round(score, {digits}) DESC, {key})::INT AS rank FROM {src}) WHERE rank <= {k})"


_WORDS = f"WITH {_Q}, {_words('documents', 'doc_id', 'text', 'd')}, {_words('q', 'subject', 'query', 'qq')}, {_bm25_sql('w', 'd', 'qq', 'doc_id')}"
_BOTH = f"{_WORDS}, {_chars('documents', 'doc_id', 'text', 'dc')}, {_chars('q', 'subject', 'query', 'qc')}, {_bm25_sql('c', 'dc', 'qc', 'doc_id')}"
SQL = {
    "retrieval_terms": f"WITH {_words('documents', 'doc_id', 'text', 'd')} SELECT doc_id, array_to_string(t, ' ') AS terms FROM d",
    "character_terms": f"WITH {_chars('documents', 'doc_id', 'text', 'd')} SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY term",
    "memory_tokens": f"WITH {_memory('memories', 'memory_id', 'text', 'm')} SELECT memory_id, array_to_string(t, ' ') AS tokens FROM m",
    "bm25_topk": f"{_WORDS} SELECT * FROM {_top('ws', 'doc_id', 10)}",
    "char_bm25_topk": f"WITH {_Q}, {_chars('documents', 'doc_id', 'text', 'dc')}, {_chars('q', 'subject', 'query', 'qc')}, {_bm25_sql('c', 'dc', 'qc', 'doc_id')} SELECT * FROM {_top('cs', 'doc_id', 10)}",
    "bm25_prefix": f"WITH {_Q}, {_words('documents', 'doc_id', 'text', 'd', 'doc_id < (SELECT max(doc_id) // 2 FROM documents WHERE text IS NOT NULL)')}, {_words('q', 'subject', 'query', 'qq')}, {_bm25_sql('w', 'd', 'qq', 'doc_id')} SELECT * FROM {_top('ws', 'doc_id', 10)}",
    "bm25_memory_max": f"WITH {_Q}, {_memory('memories', 'memory_id', 'text', 'm')}, {_memory('q', 'subject', 'query', 'qm')}, {_bm25_sql('m', 'm', 'qm', 'memory_id', 1.45)}, u AS (SELECT subject, memory_id, score / max(score) OVER (PARTITION BY subject) AS score FROM ms) SELECT * FROM {_top('u', 'memory_id', 10)}",
    "rank_fusion": f"{_BOTH}, f AS (SELECT subject, doc_id, sum(p) AS score FROM (SELECT subject, doc_id, 1.0e0 / (60 + rank) AS p FROM {_top('ws', 'doc_id', 50)} UNION ALL SELECT subject, doc_id, 0.72e0 * (1.0e0 / (60 + rank)) FROM {_top('cs', 'doc_id', 50)}) GROUP BY ALL) SELECT * FROM {_top('f', 'doc_id', 10, 9)}",
    "score_norms": f"{_WORDS}, t AS (SELECT * FROM {_top('ws', 'doc_id', 20)}), x AS (SELECT *, max(score) OVER (PARTITION BY subject) AS hi, min(score) OVER (PARTITION BY subject) AS lo FROM t) SELECT subject, doc_id, round(CASE WHEN hi > 0 THEN score / hi ELSE 0 END, 6) AS over_max, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS min_max FROM x",
    "recall_at_k": f"{_WORDS}, g AS (SELECT DISTINCT subject, doc_id FROM subject_labels WHERE subject IS NOT NULL), p AS (SELECT subject, count(*) AS gold, count(*) FILTER (rank <= 10) AS hit, min(rank) AS first FROM g LEFT JOIN {_top('ws', 'doc_id', 9000000000000)} r USING (subject, doc_id) GROUP BY subject) SELECT count(*) AS queries, round(avg((hit > 0)::INT), 6) AS any_at_10, round(avg((hit = gold)::INT), 6) AS full_at_10, round(sum(hit) / sum(gold)::DOUBLE, 6) AS micro_at_10, round(avg(coalesce(1.0e0 / first, 0)), 6) AS mrr FROM p",
    "neighbour_flux": "WITH f AS (SELECT scope, memory_id, max(mass) OVER (PARTITION BY scope ORDER BY created_at, memory_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM memories WHERE scope IS NOT NULL AND mass IS NOT NULL AND created_at IS NOT NULL) SELECT scope, memory_id, round(CASE WHEN max(x) OVER (PARTITION BY scope) > 0 THEN x / max(x) OVER (PARTITION BY scope) ELSE 0 END, 6) AS flux FROM f",
    "entity_resonance": f"WITH f AS (SELECT DISTINCT fact_id, memory_id, evidence FROM fact_frames WHERE evidence IS NOT NULL AND memory_id IS NOT NULL), j AS (SELECT fact_id, {T.sql_value_items('evidence')} AS q, {T.sql_value_items('text')} AS x FROM f JOIN memories USING (memory_id) WHERE text IS NOT NULL) SELECT fact_id, round(max(len(list_intersect(q, x)) / greatest(1, len(q))::DOUBLE), 6) AS resonance FROM j GROUP BY fact_id",
    "date_ramp": "SELECT doc_id, round((row_number() OVER (PARTITION BY source ORDER BY created_at, doc_id) - 1) / greatest(1, count(*) OVER (PARTITION BY source) - 1)::DOUBLE, 6) AS ramp FROM documents WHERE created_at IS NOT NULL AND source IS NOT NULL",
    "cooccurring_terms": f"""WITH {_Q}, d AS (SELECT DISTINCT doc_id, unnest({T.sql_content_words('text')}) AS term FROM documents WHERE text IS NOT NULL),
n AS (SELECT greatest(8.0e0, 0.4e0 * count(*)) AS cap FROM documents WHERE text IS NOT NULL), df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
a AS (SELECT DISTINCT subject, unnest({T.sql_content_words('query')}) AS term FROM q), h AS (SELECT DISTINCT subject, doc_id FROM d JOIN a USING (term)),
z AS (SELECT subject, count(*) AS anchors FROM h GROUP BY subject), o AS (SELECT subject, term, count(*) AS overlap FROM h JOIN d USING (doc_id) GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT subject, term, overlap / sqrt(anchors::DOUBLE * df) AS score FROM o JOIN df USING (term) JOIN z USING (subject), n WHERE df <= cap AND (subject, term) NOT IN (SELECT subject, term FROM a))
SELECT * FROM {_top('s', 'term', 24)}""",
}
