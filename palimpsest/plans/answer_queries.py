"""Queries of text forms, inferred facts and answers found in sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import answers as A
from palimpsest.functions import text as T
from palimpsest.session import read_table


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("text is not null and memory_id is not null")
    return m.select("memory_id", A.normalized_text("text").alias("plain"), A.ascii_words("text").alias("ascii"), A.approx_tokens("text").alias("tokens"), F.size(A.trigrams("text")).alias("trigrams"), F.array_join(A.time_keys("text", F.col("created_at")), "|").alias("times"))


def goal_names(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories").where("text is not null and memory_id is not null")
    return m.select("memory_id", F.array_join(F.array_sort(A.goal_names("text")), "|").alias("names"))


def inferred_facts(spark: SparkSession, d: str) -> DataFrame:
    """Subject, predicate, object, polarity and key told by the evidence sentence of each fact."""
    f = read_table(spark, d, "fact_frames").where("evidence is not null and fact_id is not null").select("fact_id", "evidence").distinct()
    f = f.withColumn("e", T.text_entities("evidence"))
    f = f.withColumn("x", A.inferred_fact("evidence", F.col("e")))
    return f.select("fact_id", "x.subject", "x.predicate", "x.object_value", "x.polarity", A.inferred_key("evidence", F.col("e"), F.col("x")).alias("key"))


def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """The first date named in each document."""
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", A.parsed_date("text").cast("string").alias("day")).where("day is not null")


def gold_sources(spark: SparkSession, d: str) -> DataFrame:
    """Memories of a fact's tenant and scope that contain its value, for the facts whose id is divisible by 20."""
    f = read_table(spark, d, "fact_frames").where("object_value is not null and scope is not null and tenant_id is not null and fact_id % 20 = 0")
    f = f.select("fact_id", "tenant_id", "scope", A.word_form("object_value").alias("answer")).where(F.length("answer") >= 2).distinct()
    m = read_table(spark, d, "memories").where("text is not null and scope is not null and tenant_id is not null").select("tenant_id", "scope", "memory_id", A.word_form("text").alias("words"))
    return f.join(m, ["tenant_id", "scope"]).where(F.contains("words", F.col("answer"))).select("fact_id", "memory_id").distinct()


def all_piece_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold every part of a subject's gloss."""
    a = read_table(spark, d, "subject_areas").select("subject", A.answer_pieces("gloss").alias("pieces")).where(F.size("pieces") > 0)
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", A.word_form("text").alias("words"))
    few = F.broadcast(a.groupBy().agg(F.collect_list(F.struct("subject", "pieces")).alias("all")))  # one row of the ten areas
    hit = docs.join(few).select("doc_id", "words", F.explode("all").alias("a"))
    return hit.where(F.forall("a.pieces", lambda p: F.contains("words", p))).select("a.subject", "doc_id")


def normal_answers(spark: SparkSession, d: str) -> DataFrame:
    """Fact values in compatibility form with folded case."""
    return read_table(spark, d, "fact_frames").where("object_value is not null").select("fact_id", A.normal_form_udf(F.col("object_value")).alias("form")).distinct()


QUERIES = {f.__name__: f for f in (text_forms, goal_names, inferred_facts, document_dates, gold_sources, all_piece_sources, normal_answers)}

_TOK = T.sql_memory_tokens
_WORDS = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"
_FIND = lambda x, p, g=1: f"regexp_extract_all({x}, '{p}', {g})"
_PLAIN = f"array_to_string({_TOK('text')}, ' ')"
_PAD = f"('  ' || {_PLAIN} || '  ')"
_EDGE = "(?:^|[^a-z0-9_])"
# the same words next to each other share a blank, which a lookahead-free pattern would eat: blanks are doubled first
_SPACED = "regexp_replace(lower(text), '([^a-z0-9_])', '\\1\\1', 'g')"
_TIMES = f"list_concat({_FIND(_SPACED, _EDGE + '(' + A.YEAR_OR_DATE.replace('[-/]', '(?:--|//)') + ')(?:[^a-z0-9_]|$)')}, {_FIND(_SPACED, _EDGE + '(' + '|'.join(A.TIME_WORDS) + ')(?:[^a-z0-9_]|$)')}, {_FIND('lower(text)', '|'.join(A.TIME_WORDS_ZH), 0)})"
_CLEAN = f"regexp_replace(regexp_replace(trim(evidence), '(?i)^(?:{A.CORRECTION_WORDS})\\s*[:：]?\\s*', ''), '[。.!！]+$', '')"
_EN = f"(?is)^(.+?)\\s+({'|'.join(A.VERBS)})\\s+(.+)$"
_ZH = f"(?is)^([㐀-鿿A-Za-z0-9 _-]{{1,40}}?)({'|'.join(A.VERBS_ZH)})(.+)$"
_PART = lambda i: f"nullif(trim(CASE WHEN regexp_matches(c, '{_EN}') THEN regexp_extract(c, '{_EN}', {i}) ELSE regexp_extract(c, '{_ZH}', {i}) END), '')"
_NEG = " OR ".join(f"contains(lower(evidence), '{c}')" for c in T.NEGATIONS)
SQL = {
    "text_forms": f"""WITH m AS (SELECT memory_id, text, created_at, {_PLAIN} AS plain FROM memories WHERE text IS NOT NULL AND memory_id IS NOT NULL)
SELECT memory_id, plain, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS ascii, greatest(1, ceil(length(text) / 4.0))::INT AS tokens,
len(list_distinct(list_transform(range(1, greatest(1, length(plain) + 2) + 1), lambda i: substr('  ' || plain || '  ', i, 3))))::INT AS trigrams,
array_to_string(list_sort(list_distinct(list_concat(list_transform({_TIMES}, lambda x: replace(replace(x, '--', '-'), '//', '/')), CASE WHEN created_at IS NULL THEN [] ELSE [strftime(created_at, '%Y-%m')] END))), '|') AS times FROM m""",
    "inferred_facts": f"""WITH f AS (SELECT DISTINCT fact_id, evidence FROM fact_frames WHERE evidence IS NOT NULL AND fact_id IS NOT NULL), g AS (SELECT *, {_CLEAN} AS c, {T.sql_text_entities('evidence')} AS e, {_TOK('evidence')} AS tok FROM f),
p AS (SELECT *, coalesce({_PART(1)}, e[1]) AS subject, lower({_PART(2)}) AS predicate, {_PART(3)} AS object_value FROM g),
k AS (SELECT *, list_filter(tok[2:], lambda w: w NOT IN ({', '.join(repr(c) for c in T.NEGATIONS)})) AS rest FROM p)
SELECT fact_id, subject, predicate, object_value, CASE WHEN {_NEG} THEN -1 ELSE 1 END AS polarity,
coalesce(CASE WHEN subject IS NOT NULL AND predicate IS NOT NULL THEN array_to_string({_TOK('subject')}, ' ') || ':' || array_to_string({_TOK('predicate')}, ' ') END, CASE WHEN len(tok) > 0 THEN coalesce(e[1], tok[1]) || ':' || coalesce(rest[1], 'state') END) AS key FROM k""",
    "document_dates": "WITH p AS (SELECT doc_id, regexp_extract(text, '(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})', ['y', 'm', 'd']) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(try_cast(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE) AS VARCHAR) AS day FROM p WHERE x.y <> '' AND try_cast(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE) IS NOT NULL",
    "gold_sources": f"WITH f AS (SELECT DISTINCT fact_id, tenant_id, scope, {_WORDS('object_value')} AS answer FROM fact_frames WHERE object_value IS NOT NULL AND scope IS NOT NULL AND tenant_id IS NOT NULL AND fact_id % 20 = 0), m AS (SELECT tenant_id, scope, memory_id, {_WORDS('text')} AS words FROM memories WHERE text IS NOT NULL) SELECT DISTINCT fact_id, memory_id FROM f JOIN m USING (tenant_id, scope) WHERE length(answer) >= 2 AND contains(words, answer)",
    "all_piece_sources": f"WITH a AS (SELECT subject, list_filter(list_transform(regexp_split_to_array(gloss, '[;,]'), lambda g: {_WORDS('g')}), lambda x: length(x) >= 2) AS pieces FROM subject_areas), d AS (SELECT doc_id, {_WORDS('text')} AS words FROM documents WHERE text IS NOT NULL) SELECT subject, doc_id FROM a, d WHERE len(pieces) > 0 AND len(list_filter(pieces, lambda p: NOT contains(words, p))) = 0",
}
