"""Queries of numbered statements and of the census over six groupings, with their SQL.

Relations are told as numbered sentences, five texts to a scope, and read back by the templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import census as C
from palimpsest.operators import statements as S
from palimpsest.session import read_table

# How the predicates of the relations are told, and the relation that the sentence stands for.
_TOLD = {
    "works at": ("is employed by", "employed_by"), "reports to": ("is married to", "married"), "member of": ("is affiliated with the religion of", "religion"), "depends on": ("was created by", "created_by"),
    "hosted by": ("was developed by", "developed_by"), "maintained by": ("was founded by", "founded_by"), "partner of": ("is famous for", "famous_for"),
}


def _sources(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "entity_relations").where("subject is not null and object_value is not null and scope is not null and relation_id is not null")
    verb = F.when(F.lit(False), "")
    for p, (words, _) in _TOLD.items():
        verb = verb.when(F.col("predicate") == p, words)
    r = r.select("scope", "relation_id", F.concat(F.col("relation_id").cast("string"), F.lit(". "), F.col("subject"), F.lit(" "), verb, F.lit(" "), F.col("object_value"), F.lit(".")).alias("line")).where("line is not null").distinct()
    lines = F.array_sort(F.collect_list(F.struct("relation_id", "line")))
    return r.groupBy("scope", F.pmod("relation_id", F.lit(5)).alias("ord")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def statement_facts(spark: SparkSession, d: str) -> DataFrame:
    f = S.statement_facts(_sources(spark, d), "scope", "ord", "text")
    return f.select(F.col("corpus").alias("scope"), "ordinal", "subject", "relation", "object")


def statement_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whom the employer of each person's spouse is known for or by, along the told relations: one question per person."""
    src = _sources(spark, d)
    f = S.statement_facts(src, "scope", "ord", "text")
    q = f.where("relation = 'married'").select("corpus", "subject").distinct()
    q = q.select("corpus", F.concat_ws("|", "corpus", "subject").alias("query_id"), F.concat(F.lit("Who is the employer of the spouse of "), F.col("subject"), F.lit("?")).alias("query"), F.lit(5).alias("prefix"))
    return S.answer_questions(f, q, S.SUPERPOSITION).select("query_id", "answer", "relation", "ordinal", F.size("path").alias("hops"))


def census_six(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "fact_frames").where("asserted_at is not null and predicate is not null and confidence is not null and fact_id is not null")
    f = f.select("fact_id", "predicate", "asserted_at", F.coalesce("polarity", F.lit(1)).cast("string").alias("member"), "confidence").distinct().withColumns({"field": F.lit("confidence"), "dimension": F.lit("polarity")})
    c = C.census_six(f, "predicate", "field", "asserted_at", "dimension", "member", "confidence")
    z = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    return c.select("level", "category", z("month"), z("week"), z("window"), z("member"), "count", F.round("sum", 3).alias("sum"))


QUERIES = {f.__name__: f for f in (statement_facts, statement_answers, census_six)}

_KEYS = ["month", "week", "window_", "member"]


def _level(name: str, keys: list[str]) -> str:
    cols = ", ".join(k if k in keys else f"'' AS {k}" for k in _KEYS).replace("window_", "window_")
    by = ", ".join(["category", *keys])
    return f"SELECT '{name}' AS level, category, {cols}, count(*) AS count, round(sum(v), 3) AS sum FROM t GROUP BY {by}"


_CUT = lambda c: f"regexp_replace(trim({c}), '[.]+$', '')"
_LEVELS = " UNION ALL ".join(_level(n, k) for n, k in (("all", []), ("month", ["month"]), ("week", ["week"]), ("window", ["window_"]), ("member", ["member"]), ("member window", ["window_", "member"])))
SQL = {
    "statement_facts": "WITH r AS (SELECT DISTINCT scope, relation_id AS ordinal, " + _CUT("subject") + " AS subject, CASE predicate " + " ".join(f"WHEN '{p}' THEN '{r}'" for p, (_, r) in _TOLD.items()) + " END AS relation, " + _CUT("object_value") + " AS object FROM entity_relations WHERE subject IS NOT NULL AND object_value IS NOT NULL AND scope IS NOT NULL AND relation_id IS NOT NULL) SELECT * FROM r WHERE relation IS NOT NULL AND subject <> '' AND object <> ''",
    "census_six": f"""WITH f AS (SELECT DISTINCT fact_id, predicate, asserted_at, coalesce(polarity, 1)::VARCHAR AS member, confidence FROM fact_frames WHERE asserted_at IS NOT NULL AND predicate IS NOT NULL AND confidence IS NOT NULL AND fact_id IS NOT NULL),
t AS (SELECT predicate AS category, strftime(asserted_at, '%Y-%m') AS month, strftime(asserted_at, '%Y-%m') || '-W' || ((day(asserted_at) - 1) // 7 + 1)::INT AS week, 'W' || (date_diff('day', (SELECT min(asserted_at) FROM f)::DATE, asserted_at::DATE) // 30 + 1)::INT AS window_, member, confidence AS v FROM f)
SELECT level, category, month, week, window_ AS "window", member, count, sum FROM ({_LEVELS})""",
}
