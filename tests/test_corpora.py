"""Readers of corpora on files of a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.chunks import fixed_chunks
from palimpsest.sources import corpora as C


def write(tmp_path, name, data, lines=False):
    p = tmp_path / name
    p.write_text("\n".join(map(json.dumps, data)) if lines else json.dumps(data))
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sessions(spark, tmp_path):
    data = [{"sample_id": "s", "conversation": {"session_2": [{"dia_id": "D2:1", "speaker": "B", "text": "two"}], "session_10": [{"dia_id": "D10:1", "speaker": "A", "text": "ten", "blip_caption": "cat"}], "session_2_date_time": "May", "speaker_a": "A"}, "qa": [{"question": "q?", "answer": 7, "evidence": ["D2:1 D10:1"]}]}]
    c = C.sessions_corpus(spark, write(tmp_path, "a.json", data))
    assert rows(c.sources, "ord", "source_id", "text", "date") == [(0, "D2:1", "B: two", "May"), (1, "D10:1", "A: ten cat", None)]
    assert rows(c.questions, "query", "answer") == [("q?", "7")] and rows(c.gold, "source_id") == [("D10:1",), ("D2:1",)]


def test_haystacks(spark, tmp_path):
    data = [{"question_id": "q1", "question": "?", "answer": "x", "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], [{"role": "user", "content": "c"}]], "haystack_dates": ["1", "2"], "answer_session_ids": ["s2"]}]
    c = C.haystack_corpus(spark, write(tmp_path, "a.json", data))
    assert rows(c.sources, "ord", "source_id", "text", "date") == [(0, "s1", "user: a\nassistant: b", "1"), (1, "s2", "user: c", "2")] and rows(c.gold, "source_id") == [("s2",)]


def test_probing(spark, tmp_path):
    turn = "struct<id:bigint,role:string,content:string,time_anchor:string>"
    df = spark.createDataFrame([("c", [[(4, "user", "hi", "t")], [(5, "user", "yo", None)]], "{'abstain': [{'question': 'q', 'answer': 'a', 'source_chat_ids': [4, 5]}]}")], f"conversation_id string, chat array<array<{turn}>>, probing_questions string")
    df.write.parquet(f"{tmp_path}/p")
    c = C.probing_corpus(spark, f"{tmp_path}/p")
    assert rows(c.sources, "ord", "source_id", "group_id", "text") == [(0, "4", 0, "hi"), (1, "5", 1, "yo")] and rows(c.gold, "source_id") == [("4",), ("5",)] and rows(c.questions, "query_id", "query") == [("c-abstain-0", "q")]


def test_personas(spark, tmp_path):
    ctx = write(tmp_path, "c.jsonl", [{"k": [{"role": "user", "content": "a"}, {"role": "user", "content": "b"}]}], lines=True)
    (tmp_path / "q.csv").write_text('shared_context_id,question_id,user_question_or_message,end_index_in_shared_context,correct_answer\nk,1,"so, what?",1,(a)\n')
    c = C.persona_corpus(spark, ctx, str(tmp_path / "q.csv"))
    assert rows(c.sources, "ord", "text") == [(0, "a"), (1, "b")] and rows(c.questions, "query", "prefix") == [("so, what?", 1)] and c.gold.count() == 0


def test_trajectories_and_turns(spark, tmp_path):
    c = C.trajectory_corpus(spark, write(tmp_path, "t.json", {"g": [{"message_list": [[{"mid": 3, "user": "u", "assistant": "v"}]], "QA": {"question": "q", "answer": "a", "target_step_id": [[3]]}}, {"message_list": ["plain"], "QA": {"question": "r", "target_step_id": []}}]}), 1)
    assert rows(c.sources, "corpus_id", "source_id", "text") == [("g/1", "3", "u v")] and rows(c.gold, "source_id") == [("3",)]
    c = C.turn_corpus(spark, write(tmp_path, "d.json", {"dialogues": [{"session_uuid": "a", "current_time": "1", "dialogue_turns": [{"speaker": "U", "content": "x"}]}, {"session_uuid": "b", "current_time": "2", "dialogue_turns": [{"speaker": "U", "content": "y?", "is_query": True, "memory_session_uuids": ["a"]}]}]}))
    assert rows(c.questions, "query", "prefix") == [("y?", 1)] and rows(c.gold, "source_id") == [("a",)]


def test_parallel_lists_and_tasks(spark, tmp_path):
    spark.createDataFrame([("one red fox", ["who?"], [["Red Fox"]])], "context string, questions array<string>, answers array<array<string>>").selectExpr("context", "questions", "transform(answers, a -> a[0]) answers").write.parquet(f"{tmp_path}/m")
    c = C.parallel_corpus(spark, f"{tmp_path}/m", fixed_chunks)
    assert rows(c.sources, "ord", "text") == [(0, "one red fox")] and c.gold.count() == 1
    c = C.task_corpus(spark, write(tmp_path, "t.jsonl", [{"id": 1, "questions": ["a?", "b?"], "answers": ["blue", "Blue"]}], lines=True))
    assert rows(c.questions, "query", "prefix") == [("b?", 1)] and rows(c.gold, "source_id") == [("0",)]


def test_group_chats(spark, tmp_path):
    d = write(tmp_path, "u1_dialogues.json", {"dialogues": {"2025-01-02": {"g": [{"speaker": "A", "dialogue": "late"}]}, "2025-01-01": {"g": [{"speaker": "A", "dialogue": "the red kite"}], "h": [{"speaker": "B", "dialogue": "hm"}]}}})
    q = write(tmp_path, "u1_qars.json", {"qars": [{"id": "1", "Q": "what?", "A": "Red kite"}]})
    c = C.group_chat_corpus(spark, d, q)
    assert rows(c.sources, "ord", "source_id", "group_id") == [(0, "2025-01-01|g", 1), (1, "2025-01-01|h", 1), (2, "2025-01-02|g", 2)] and rows(c.gold, "source_id") == [("2025-01-01|g",)]


def test_trajectory_texts(spark):
    s = "id string, goal string, outcome string, start_url string, states array<struct<state_index:int,url:string,action:string,thought:string,accessibility_tree:string>>"
    df = spark.createDataFrame([("t", "g", "ok", "u", [(0, "/a", "click", None, "TREE")]), ("x", None, None, None, None)], s)
    col = lambda tree: C.trajectory_text(F.col("states"), F.col("goal"), F.col("outcome"), F.col("start_url"), tree).alias("t")
    full, note = (df.where("id = 't'").select(col(t)).first().t for t in (True, False))
    assert full == "Goal: g\nOutcome: ok\nStart URL: u\nState 0\nURL: /a\nAction: click\nThought: \nAccessibility tree:\nTREE" and "TREE" not in note
    q = spark.createDataFrame([(["t", "z"],)], "need array<string>")
    assert [r.id for r in C.required_trajectories(df, q, "need").collect()] == ["t"]


def test_session_records_feed_the_ledger(spark, tmp_path):
    (tmp_path / "p").mkdir()
    data = [{"operation": "update", "session_type": "todo", "date": "2025-01-01", "operation_details": {"category": "todo_list", "item": "new", "old_item": "stale"}, "conversation": [{"speaker": "U", "message": "hello", "share_memory": True}, {"speaker": "U", "message": "bye"}]}]
    r = C.session_records(spark, write(tmp_path / "p", "s.json", data)).first()
    assert r.memory_text == "hello" and "stale" not in r.text and "hello" not in r.text and "new" in r.text and json.loads(r.details)["old_item"] == "stale"
