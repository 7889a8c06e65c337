"""Ledgers by category: categories of a question, live events, budgets, numeric answers."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import census as C

SCHEMA = "corpus string, ord long, operation string, session_type string, date string, details string, memory_text string"


def select(spark, events, query, prefix=None, as_of=None):
    rows = [("c", i, op, kind, date, json.dumps(details), said) for i, (op, kind, date, details, said) in enumerate(events)]
    df = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([("c", 1, query, len(rows) if prefix is None else prefix, as_of)], "corpus string, query_id long, query string, prefix long, as_of string")
    s = C.ledger_select(df, q)
    return sorted(r.ord for r in s.collect()), df, q, s


def food(kind, amount):
    return {"category": "food_expenses", "item": {"expense_type": kind, "amount": amount}}


def test_measurements_and_preferences(spark):
    events = [("add", "x", "2025-01-01", food("coffee", 4), ""), ("delete", "x", "2025-01-02", food("coffee", 4), ""), ("add", "x", "2025-01-03", {"category": "artists", "item": "Nina"}, ""), ("add", "no_memory", "2025-01-04", {"category": "no_memory"}, "")]
    assert select(spark, events, "What is my total food spending?")[0] == [0]
    assert select(spark, events, "Suggest some music by artists I like.")[0] == [2]
    assert select(spark, events, "Suggest some music by artists I like.", prefix=2)[0] == []


def test_mutable_lists_fold_by_item(spark):
    todo = lambda op, x, day=1, **more: (op, "x", f"2025-01-0{day}", {"category": "todo_list", "item": {"description": x}} | more, "")
    events = [todo("add", "alpha"), todo("add", "beta"), todo("delete", "Alpha ")]
    assert select(spark, events, "What tasks remain on my todo list?")[0] == [1]
    assert select(spark, events, "What tasks remain on my todo list?", prefix=2)[0] == [0, 1]
    # an update that names an old item replaces it, a later add after a deletion is a new origin
    events = [todo("add", "alpha"), todo("update", "gamma", 2, old_item={"description": "alpha"}), todo("delete", "gamma", 3), todo("add", "gamma", 4), todo("update", "gamma", 5)]
    assert select(spark, events, "todo list?")[0] == [3]


def test_categories_do_not_leak(spark):
    events = [("add", "x", "2025-01-01", {"category": "todo_list", "item": {"description": "a"}}, ""), ("add", "x", "2025-01-01", {"category": "already_read_list", "item": "b"}, "")]
    assert select(spark, events, "What is on my todo list?")[0] == [0]
    both = [("add", "x", "2025-01-01", food("coffee", 4), ""), ("add", "x", "2025-01-01", food("lunch", 12), "")]
    assert select(spark, both, "How much did I spend on coffee?")[0] == [0]


def test_calendar_events_end(spark):
    event = lambda name, date: ("add", "x", "2025-01-01", {"category": "calendar_event", "item": {"event_name": name, "date": date, "created_at": "2025-01-01"}}, "")
    events = [event("a", "2025-02-01"), event("b", "+5 days"), event("c", "someday")]
    assert select(spark, events, "Which upcoming events do I have?", as_of="2025-01-10")[0] == [0, 2]


def test_numbers(spark):
    events = [("add", "x", f"2025-01-{d:02d}", food(k, a), "") for d, k, a in ((1, "coffee", 10), (2, "coffee", 15), (9, "lunch", 30))]
    events += [("add", "x", d, {"category": "step_tracker", "item": {"step_count": n}}, "") for d, n in (("2025-01-03", 100), ("2025-01-10", 300), ("2025-02-20", 350))]

    def answer(query):
        _, df, q, s = select(spark, events, query)
        return [(r.phase, r.value, r.unit) for r in C.numeric_answers(df, s, q).collect()]

    assert answer("How much did I spend on coffee?") == [(None, 25.0, "currency")]
    assert answer("What is my total food spending?") == [(None, 55.0, "currency")]
    assert answer("How many steps did I walk?") == [(None, 750.0, "steps")]
    assert answer("Which week had the most steps?") == [("2025-02-W3", 350.0, "steps")]
    assert answer("Which month had the most steps?") == [("2025-01", 400.0, "steps")]
    assert answer("Did I meet my budget?") == []


@pytest.mark.parametrize("query,want", [("How many books did I read?", (48, 300, 300, 51)), ("What did I use previously?", (24, 96, 96, 48)), ("What should I read?", (16, 32, 300, 51)), ("What color is the car?", (16, 32, 32, 48))])
def test_budgets(spark, query, want):
    b = C.census_budgets(F.col("q"), F.lit(300), F.lit(3))
    r = spark.createDataFrame([(query,)], "q string").select(*[c.alias(k) for k, c in b.items()]).first()
    assert (r.facts, r.census, r.collapsed, r.ledger) == want


def test_terms_and_invalidations(spark):
    r = spark.createDataFrame([("How much did I spend on food?", "session operation delete category todo list", "session operation add category todo list")], "q string, a string, b string")
    x = r.select(C.expanded_terms(F.col("q")).alias("t"), C.domain_terms(F.lit("a book about music")).alias("d"), C.is_invalidation(F.col("a")).alias("a"), C.is_invalidation(F.col("b")).alias("b")).first()
    assert {"coffee", "amount", "spend"} <= set(x.t) and {"author", "album"} <= set(x.d) and x.a and not x.b
