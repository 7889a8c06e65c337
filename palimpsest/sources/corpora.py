"""Readers of public dialogue and memory corpora: each gives sources, questions and gold answers in one shape.

sources(corpus_id, ord, source_id, group_id, role, text, date), questions(corpus_id, query_id, query, prefix, answer) and
gold(corpus_id, query_id, source_id). ord is the place of a text in its corpus, from 0; a question sees the sources before
its prefix. Files are read and flattened in the JVM; nothing is collected. A missing list, turn or field gives no row.
"""

from __future__ import annotations

import ast
import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.answers import dialogue_ids, word_form


class Corpus(NamedTuple):
    sources: DataFrame
    questions: DataFrame
    gold: DataFrame


_ALL = 2**31 - 1


def _ordered(df: DataFrame, order: list) -> DataFrame:
    """Sources with their place in the corpus; ``order`` sorts them."""
    at = F.row_number().over(Window.partitionBy("corpus_id").orderBy(*order)) - 1
    return df.withColumn("ord", at.cast("long")).select("corpus_id", "ord", "source_id", F.col("group_id").cast("long").alias("group_id"), "role", "text", "date")


def _questions(df: DataFrame) -> DataFrame:
    return df.select("corpus_id", "query_id", "query", F.col("prefix").cast("long").alias("prefix"), "answer")


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of JSON files, each as one variant, whatever its keys are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("v"))


def _each(df: DataFrame, variant: str, name: str) -> DataFrame:
    """One row per element or field of a variant column, as (name_pos, name_key, name); other columns stay."""
    view = f"each_{name}_{id(df)}"
    df.createOrReplaceTempView(view)
    keep = "".join(f"{c}, " for c in df.columns if c != variant)
    return df.sparkSession.sql(f"SELECT {keep}e.pos AS {name}_pos, e.key AS {name}_key, e.value AS {name} FROM {view}, LATERAL variant_explode({variant}) e")


def _get(variant: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(variant), f"$.{path}", kind)


def sessions_corpus(spark: SparkSession, path: str) -> Corpus:
    """JSON list of samples: conversation.session_N turns (dia_id, speaker, text, blip_caption), qa (question, answer, evidence)."""
    v = _each(_whole_file(spark, path), "v", "sample").select(F.coalesce(_get("sample", "sample_id"), F.col("sample_pos").cast("string")).alias("corpus_id"), F.col("sample"))
    c = v.select("corpus_id", _get("sample", "conversation", "variant").alias("c"))
    s = _each(c, "c", "session").withColumn("n", F.regexp_extract("session_key", r"^session_(\d+)$", 1).try_cast("int"))
    dates = s.select("corpus_id", F.regexp_extract("session_key", r"^session_(\d+)_date_time$", 1).try_cast("int").alias("n"), F.expr("try_variant_get(session, '$', 'string')").alias("date")).where("n is not null")
    t = _each(s.where("n is not null").select("corpus_id", "n", "session"), "session", "turn")
    text = F.concat(_get("turn", "speaker"), F.lit(": "), F.trim(F.concat_ws(" ", _get("turn", "text"), _get("turn", "blip_caption"))))
    t = t.select("corpus_id", "n", "turn_pos", _get("turn", "dia_id").alias("source_id"), F.col("n").alias("group_id"), _get("turn", "speaker").alias("role"), text.alias("text")).join(dates, ["corpus_id", "n"], "left")
    q = _each(v.select("corpus_id", _get("sample", "qa", "variant").alias("q")), "q", "qa")
    q = q.withColumn("query_id", F.concat_ws("-", "corpus_id", "qa_pos"))
    gold = q.select("corpus_id", "query_id", F.explode(dialogue_ids(F.to_json(_get("qa", "evidence", "variant")))).alias("source_id")).where(F.rlike("source_id", F.lit(r"^D\d+:\d+$")))
    return Corpus(_ordered(t, ["n", "turn_pos"]), _questions(q.select("corpus_id", "query_id", _get("qa", "question").alias("query"), F.lit(_ALL).alias("prefix"), _get("qa", "answer").alias("answer"))), gold)


def haystack_corpus(spark: SparkSession, path: str) -> Corpus:
    """JSON list of questions, each with its own sessions: haystack_session_ids, haystack_sessions (role, content), haystack_dates, answer_session_ids."""
    v = _each(_whole_file(spark, path), "v", "x").select(_get("x", "question_id").alias("corpus_id"), "x").where("corpus_id is not null")
    ids = _each(v.select("corpus_id", _get("x", "haystack_session_ids", "variant").alias("l")), "l", "i").select("corpus_id", F.col("i_pos").alias("n"), F.expr("try_variant_get(i, '$', 'string')").alias("source_id"))
    dates = _each(v.select("corpus_id", _get("x", "haystack_dates", "variant").alias("l")), "l", "d").select("corpus_id", F.col("d_pos").alias("n"), F.expr("try_variant_get(d, '$', 'string')").alias("date"))
    s = _each(v.select("corpus_id", _get("x", "haystack_sessions", "variant").alias("l")), "l", "s").withColumnRenamed("s_pos", "n")
    t = _each(s.select("corpus_id", "n", "s"), "s", "t")
    line = F.concat(_get("t", "role"), F.lit(": "), _get("t", "content"))
    text = t.groupBy("corpus_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_pos", line.alias("x")))), lambda z: z["x"]), "\n").alias("text"))  # one session
    src = text.join(ids, ["corpus_id", "n"]).join(dates, ["corpus_id", "n"], "left").select("corpus_id", "n", "source_id", F.col("n").alias("group_id"), F.lit("session").alias("role"), "text", "date")
    q = v.select("corpus_id", F.col("corpus_id").alias("query_id"), _get("x", "question").alias("query"), F.lit(_ALL).alias("prefix"), _get("x", "answer").alias("answer"))
    gold = _each(v.where(~F.endswith("corpus_id", F.lit("_abs"))).select("corpus_id", _get("x", "answer_session_ids", "variant").alias("l")), "l", "g").select("corpus_id", F.col("corpus_id").alias("query_id"), F.expr("try_variant_get(g, '$', 'string')").alias("source_id"))
    return Corpus(_ordered(src, ["n"]), _questions(q), gold)


def probing_corpus(spark: SparkSession, path: str) -> Corpus:
    """Parquet rows with chat (batches of turns, or turns) and probing_questions (a Python literal: kinds of lists of questions)."""
    rows = spark.read.parquet(path).withColumn("corpus_id", F.col("conversation_id").cast("string"))
    chat = rows.select("corpus_id", F.parse_json(F.to_json("chat")).alias("v"))
    outer = _each(chat, "v", "b")
    nested = outer.where(F.expr("schema_of_variant(b) like 'ARRAY%'")).select("corpus_id", F.col("b_pos").alias("n"), "b")
    flat = outer.where(F.expr("schema_of_variant(b) like 'OBJECT%'")).select("corpus_id", F.lit(0).alias("n"), F.col("b_pos").alias("t_pos"), F.col("b").alias("t"))
    t = _each(nested, "b", "t").select("corpus_id", "n", "t_pos", "t").unionByName(flat)
    src = t.select("corpus_id", "n", "t_pos", F.coalesce(_get("t", "id"), _get("t", "index"), F.concat_ws("-", "n", "t_pos")).alias("source_id"), F.col("n").alias("group_id"), _get("t", "role").alias("role"), _get("t", "content").alias("text"), _get("t", "time_anchor").alias("date"))

    def literal(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(ast.literal_eval(x), default=str)
            except (ValueError, SyntaxError, TypeError):
                return None

        return s.map(one)

    kinds = _each(rows.select("corpus_id", F.try_parse_json(F.pandas_udf(literal, "string")("probing_questions")).alias("v")).where("v is not null"), "v", "k")
    q = _each(kinds.select("corpus_id", "k_key", "k"), "k", "q").withColumn("query_id", F.concat_ws("-", "corpus_id", "k_key", "q_pos"))
    ids = F.regexp_extract_all(F.coalesce(F.to_json(_get("q", "source_chat_ids", "variant")), F.lit("")), F.lit(r"\d+"), F.lit(0))
    gold = q.select("corpus_id", "query_id", F.explode(F.array_distinct(ids)).alias("source_id"))
    return Corpus(_ordered(src, ["n", "t_pos"]), _questions(q.select("corpus_id", "query_id", _get("q", "question").alias("query"), F.lit(_ALL).alias("prefix"), _get("q", "answer").alias("answer"))), gold)


def persona_corpus(spark: SparkSession, contexts: str, questions: str) -> Corpus:
    """JSON lines {context id: turns} and CSV questions that see their context up to end_index_in_shared_context."""
    c = _each(spark.read.text(contexts).select(F.parse_json("value").alias("v")), "v", "c").select(F.col("c_key").alias("corpus_id"), "c")
    t = _each(c, "c", "t")
    src = t.select("corpus_id", "t_pos", F.col("t_pos").cast("string").alias("source_id"), F.lit(0).alias("group_id"), _get("t", "role").alias("role"), _get("t", "content").alias("text"), F.lit(None).cast("string").alias("date"))
    q = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(questions)
    q = q.select(F.col("shared_context_id").alias("corpus_id"), F.col("question_id").alias("query_id"), F.col("user_question_or_message").alias("query"), F.col("end_index_in_shared_context").try_cast("long").alias("prefix"), F.col("correct_answer").alias("answer"))
    return Corpus(_ordered(src, ["t_pos"]), _questions(q), q.select("corpus_id", "query_id", F.lit("").alias("source_id")).limit(0))


def trajectory_corpus(spark: SparkSession, path: str, per_group: int = 50) -> Corpus:
    """JSON files {group: trajectories} with nested message_list and QA (question, answer, target_step_id); the first of each group."""
    g = _each(_whole_file(spark, path), "v", "g")
    x = _each(g.select("path", "g_key", "g"), "g", "x")
    first = F.row_number().over(Window.partitionBy("g_key").orderBy("path", "x_pos"))
    x = x.withColumn("rn", first).where(F.col("rn") <= per_group).withColumn("corpus_id", F.concat_ws("/", "g_key", "rn")).select("corpus_id", "x")
    m = _each(x.select("corpus_id", _get("x", "message_list", "variant").alias("m")), "m", "m1").select("corpus_id", "m1_pos", "m1")
    deep = _each(m.where(F.expr("schema_of_variant(m1) like 'ARRAY%'")), "m1", "t").select("corpus_id", F.col("m1_pos").alias("n"), "t_pos", "t")
    flat = m.where(F.expr("schema_of_variant(m1) not like 'ARRAY%'")).select("corpus_id", F.lit(0).alias("n"), F.col("m1_pos").alias("t_pos"), F.col("m1").alias("t"))
    t = deep.unionByName(flat)
    said = F.concat_ws(" ", _get("t", "user"), _get("t", "assistant"), _get("t", "message"), _get("t", "content"), F.expr("CASE WHEN schema_of_variant(t) = 'STRING' THEN try_variant_get(t, '$', 'string') END"))
    at = F.row_number().over(Window.partitionBy("corpus_id").orderBy("n", "t_pos")) - 1
    t = t.withColumn("at", at)
    src = t.select("corpus_id", "n", "t_pos", F.coalesce(_get("t", "mid"), _get("t", "id"), F.col("at").cast("string")).alias("source_id"), F.col("n").alias("group_id"), F.lit("turn").alias("role"), said.alias("text"), _get("t", "time").alias("date"))
    q = x.select("corpus_id", F.col("corpus_id").alias("query_id"), _get("x", "QA.question").alias("query"), F.lit(_ALL).alias("prefix"), _get("x", "QA.answer").alias("answer"), F.regexp_extract_all(F.coalesce(F.to_json(_get("x", "QA.target_step_id", "variant")), F.lit("")), F.lit(r"\d+"), F.lit(0)).alias("g"))
    return Corpus(_ordered(src, ["n", "t_pos"]), _questions(q), q.select("corpus_id", "query_id", F.explode(F.array_distinct("g")).alias("source_id")))


def turn_corpus(spark: SparkSession, path: str) -> Corpus:
    """JSON files {dialogues}: sessions (session_uuid, current_time, dialogue_turns); a turn with is_query is a question that sees what came before."""
    d = _each(_whole_file(spark, path).withColumn("corpus_id", F.element_at(F.split("path", "/"), -1)).select("corpus_id", _get("v", "dialogues", "variant").alias("d")), "d", "s")
    t = _each(d.select("corpus_id", "s_pos", _get("s", "session_uuid").alias("sid"), _get("s", "current_time").alias("date"), _get("s", "dialogue_turns", "variant").alias("x")), "x", "t")
    asks = F.coalesce(_get("t", "is_query", "boolean"), F.lit(False))
    line = F.concat(_get("t", "speaker"), F.lit(": "), _get("t", "content"))
    s = t.groupBy("corpus_id", "s_pos", "sid", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_pos", line.alias("x")))), lambda z: z["x"]), "\n").alias("text"))  # one session
    src = s.select("corpus_id", "s_pos", F.col("sid").alias("source_id"), F.col("s_pos").alias("group_id"), F.lit("session").alias("role"), "text", "date")
    q = t.where(asks).withColumn("query_id", F.concat_ws("-", "corpus_id", "s_pos", "t_pos"))
    gold = _each(q.select("corpus_id", "query_id", _get("t", "memory_session_uuids", "variant").alias("l")), "l", "g").select("corpus_id", "query_id", F.expr("try_variant_get(g, '$', 'string')").alias("source_id"))
    return Corpus(_ordered(src, ["s_pos"]), _questions(q.select("corpus_id", "query_id", _get("t", "content").alias("query"), F.col("s_pos").alias("prefix"), F.lit(None).cast("string").alias("answer"))), gold)


def parallel_corpus(spark: SparkSession, path: str, chunks) -> Corpus:
    """Parquet rows of context, questions and answers (parallel lists); ``chunks`` cuts a text column into an array of texts.

    A chunk is gold for a question if it contains the answer, both in word form.
    """
    rows = spark.read.parquet(path).withColumn("corpus_id", F.xxhash64("context").cast("string"))
    c = rows.select("corpus_id", F.posexplode(chunks(F.col("context"))).alias("n", "text"))
    src = _ordered(c.select("corpus_id", "n", F.col("n").cast("string").alias("source_id"), F.col("n").alias("group_id"), F.lit("chunk").alias("role"), "text", F.lit(None).cast("string").alias("date")), ["n"])
    q = rows.select("corpus_id", F.posexplode(F.arrays_zip("questions", "answers")).alias("i", "x"))
    q = q.select("corpus_id", F.concat_ws("-", "corpus_id", "i").alias("query_id"), F.col("x.questions").cast("string").alias("query"), F.lit(_ALL).alias("prefix"), F.col("x.answers").cast("string").alias("answer"))
    return Corpus(src, _questions(q), contained_answers(src, q))


def contained_answers(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(corpus_id, query_id, source_id): the sources of a question's corpus, before its prefix, that contain its answer."""
    a = questions.where("answer is not null").select("corpus_id", "query_id", "prefix", word_form("answer").alias("a")).where(F.length("a") >= 2)
    s = sources.select("corpus_id", "ord", "source_id", word_form("text").alias("w"))
    return a.join(s, "corpus_id").where((F.col("ord") < F.col("prefix")) & F.contains("w", F.col("a"))).select("corpus_id", "query_id", "source_id")


def group_chat_corpus(spark: SparkSession, dialogues: str, questions: str) -> Corpus:
    """JSON {dialogues: {date: {group: [speaker, dialogue]}}} and {qars: [id, Q, A]}: one source per day and group."""
    user = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(\w+?)(?:_(?:dialogues?|qars?))?\.json", 1)
    d = _each(_whole_file(spark, dialogues).withColumn("corpus_id", user).select("corpus_id", _get("v", "dialogues", "variant").alias("d")), "d", "day")
    g = _each(d.select("corpus_id", "day_key", "day"), "day", "g")
    t = _each(g.select("corpus_id", "day_key", "g_key", "g"), "g", "t")
    line = F.concat(_get("t", "speaker"), F.lit(": "), _get("t", "dialogue"))
    s = t.groupBy("corpus_id", "day_key", "g_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_pos", line.alias("x")))), lambda z: z["x"]), "\n").alias("text"))  # one group's day
    src = s.select("corpus_id", F.concat_ws("|", "day_key", "g_key").alias("source_id"), F.dense_rank().over(Window.partitionBy("corpus_id").orderBy("day_key")).alias("group_id"), F.col("g_key").alias("role"), "text", F.col("day_key").alias("date"))
    q = _each(_whole_file(spark, questions).withColumn("corpus_id", user).select("corpus_id", _get("v", "qars", "variant").alias("q")), "q", "q1")
    q = q.select("corpus_id", _get("q1", "id").alias("query_id"), _get("q1", "Q").alias("query"), F.lit(_ALL).alias("prefix"), _get("q1", "A").alias("answer"))
    o = _ordered(src, ["date", "source_id"])
    return Corpus(o, _questions(q), contained_answers(o, q))


def task_corpus(spark: SparkSession, path: str) -> Corpus:
    """JSON lines (id, questions, answers): each subtask is a question that sees the subtasks before it."""
    rows = spark.read.json(path).select(F.col("id").cast("string").alias("corpus_id"), F.posexplode(F.arrays_zip("questions", "answers")).alias("n", "x"))
    rows = rows.select("corpus_id", "n", F.col("x.questions").cast("string").alias("q"), F.col("x.answers").cast("string").alias("a"))
    src = rows.select("corpus_id", "n", F.col("n").cast("string").alias("source_id"), F.col("n").alias("group_id"), F.lit("subtask").alias("role"), F.concat_ws("\n", "q", "a").alias("text"), F.lit(None).cast("string").alias("date"))
    q = rows.where("n > 0").select("corpus_id", F.concat_ws("-", "corpus_id", "n").alias("query_id"), F.col("q").alias("query"), F.col("n").alias("prefix"), F.col("a").alias("answer"))
    o = _ordered(src, ["n"])
    return Corpus(o, _questions(q), contained_answers(o, q))


def trajectory_text(states: Column, goal: Column, outcome: Column, start: Column, tree: bool = True) -> Column:
    """A trajectory as text; without ``tree`` the accessibility trees are not even read."""
    z = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.array(F.concat(F.lit("Goal: "), z(goal)), F.concat(F.lit("Outcome: "), z(outcome)), F.concat(F.lit("Start URL: "), z(start)))

    def lines(s: Column) -> Column:
        own = [F.concat(F.lit("URL: "), z(s["url"])), F.concat(F.lit("Action: "), z(s["action"])), F.concat(F.lit("Thought: "), z(s["thought"]))]
        return F.array(F.concat(F.lit("State "), z(s["state_index"])), *own, F.concat(F.lit("Accessibility tree:\n"), z(s["accessibility_tree"]))) if tree else F.array(*own)

    return F.array_join(F.concat(head, F.flatten(F.transform(F.coalesce(states, F.array()), lines))), "\n")


def required_trajectories(trajectories: DataFrame, questions: DataFrame, ids: str) -> DataFrame:
    """The trajectories that some question's haystack names: a semi-join at the scan."""
    need = questions.select(F.explode(ids).alias("id")).distinct()
    return trajectories.join(need, "id", "left_semi")


def session_records(spark: SparkSession, path: str) -> DataFrame:
    """Session files of structured records as the ledger reads them: corpus, ord, operation, session_type, date, details, memory_text, text.

    ``text`` is what is searched: operation, category and the leaves of the details; of updates without what was before
    (old_...), and without the conversation.
    """
    v = _each(_whole_file(spark, path), "v", "r").withColumn("corpus", F.element_at(F.split("path", "/"), -2))
    talk = _each(v.select("corpus", "path", "r_pos", _get("r", "conversation", "variant").alias("l")), "l", "t")
    line = F.struct("t_pos", _get("t", "message").alias("x"), F.coalesce(_get("t", "share_memory", "boolean"), F.lit(False)).alias("s"))
    talk = talk.groupBy("corpus", "path", "r_pos").agg(F.array_sort(F.collect_list(line)).alias("m"))  # one session's turns
    j = v.join(talk, ["corpus", "path", "r_pos"], "left")
    shared = F.array_join(F.transform(F.filter("m", lambda z: z["s"]), lambda z: z["x"]), " ")
    all_said = F.array_join(F.transform("m", lambda z: z["x"]), " ")
    details = F.to_json(_get("r", "operation_details", "variant"))
    op = F.lower(_get("r", "operation"))
    new = F.when(op == "update", F.regexp_replace(details, r'"old_\w+"\s*:\s*(?:"(?:[^"\\]|\\.)*"|\{[^{}]*\}|[^,{}\[\]]+),?', "")).otherwise(details)
    flat = F.trim(F.regexp_replace(F.coalesce(new, F.lit("")), r'[{}\[\]",:]+', " "))
    text = F.concat_ws(" ", F.lit("session operation"), op, F.lit("category"), _get("r", "session_type"), flat, F.when(op != "update", all_said))
    ord_ = (F.row_number().over(Window.partitionBy("corpus").orderBy("path", "r_pos")) - 1).cast("long")
    return j.select("corpus", ord_.alias("ord"), _get("r", "operation").alias("operation"), _get("r", "session_type").alias("session_type"), _get("r", "date").alias("date"), details.alias("details"), shared.alias("memory_text"), F.regexp_replace(text, r"\s+", " ").alias("text"))
