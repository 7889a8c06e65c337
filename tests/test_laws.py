"""Laws of relevance on fields whose result is known."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import answers as A
from palimpsest.operators import laws as W


def one():
    return F.lit(1.0)


@pytest.fixture(scope="module")
def ev(spark):
    return lambda *cols: spark.range(1).select(*cols).first()


def test_shares_sum_to_one(ev):
    for shares in (W.COGNITIVE, W.CAPSULE, W.GRAVITY, W.FOCUS, W.TETHER, W.PERIAPSIS):
        assert ev(W.weigh(shares, {k: one() for k in shares}))[0] == pytest.approx(1.0)


def test_time_and_contradiction(spark, ev):
    now, old, future = (F.lit(dt.datetime(2025, m, 1)) for m in (6, 1, 9))
    t, f, none = F.lit(True), F.lit(False), F.lit(None).cast("timestamp")
    assert ev(W.temporal_phase(future, none, old, now, t), W.temporal_phase(future, none, old, now, f))[:] == (0.75, 0.15)
    assert ev(W.temporal_phase(none, old, old, now, t), W.temporal_phase(none, none, old, now, f))[:] == (0.70, pytest.approx(math.exp(-151 / 120)))
    df = spark.createDataFrame([("I never ate 5", "I ate 7"), ("I ate 5", "I ate 5"), ("", "x")], "q string, t string")
    assert [r[0] for r in df.select(W.contradiction("q", "t")).collect()] == [1.0, 0.0, 0.0]


def test_forces(ev):
    g = W.gravity({k: one() for k in W.GRAVITY}, home=F.lit(0.5), migrates=one())
    r = ev(g["attraction"], g["net"], g["capture"])
    assert r[0] == pytest.approx(1.0) and r[1] == pytest.approx(1 - 0.05 - 0.035) and r[2] == pytest.approx(1 / (1 + math.exp(-r[1] / 0.16)))
    assert ev(W.planetary_force({"a": F.lit(0.5)}, {"a": one()}, one(), F.lit(False)))[0] == pytest.approx(0.78 * 0.3)
    assert ev(W.cognitive_force({"semantic": one(), "role": one()}, F.lit(365.0)))[0] == pytest.approx(0.54 + 0.08 * math.exp(-1))
    assert ev(W.covered_goals(F.array(F.lit(0.9), F.lit(0.5), F.lit(0.7))))[0] == [0, 2]
    assert ev(W.rarity(F.array(F.lit(0), F.lit(2))))[0] == pytest.approx((1 + 0.5) / 2)
    a, b = F.create_map(F.lit("x"), one(), F.lit("y"), F.lit(0.5)), F.create_map(F.lit("x"), F.lit(0.8))
    assert ev(W.tidal_link(a, b, F.lit(0.0), one()))[0] == pytest.approx(0.8 * 1.0)


def test_directives(ev):
    d = lambda q, t, role, family: ev(W.directive_gravity(F.lit(q), F.lit(t), F.lit(role), F.lit(family)))[0]
    assert d("How can I implement a parser?", "Always use code blocks", "instruction", "format") == pytest.approx(0.24 + 0.14 * 0.45)
    assert d("When did I implement the parser?", "Always use code blocks", "instruction", "format") == 0.0
    assert d("Recommend a library", "I prefer small libraries", "preference", "dependencies") == 0.0
    assert d("Recommend a library that I would prefer", "I prefer small libraries", "preference", "dependencies") > 0.24


def test_parts_of_questions(ev):
    q = F.lit("Could you tell me where I went and what I bought?")
    assert ev(W.capsule_goals(F.lit("red, green and blue things")))[0] == ["red, green and blue things", "green", "blue things"]
    assert ev(W.gravity_goals(F.lit("one thing")))[0] == ["one thing"] and ev(W.gravity_goals(F.lit("red while blue; it")))[0] == ["red", "blue"]
    assert ev(W.clauses(F.lit("Which camera did Maya buy and which lens did Omar use?")))[0] == ["Which camera did Maya buy and which lens did Omar use", "Which camera did Maya buy", "which lens did Omar use"]
    assert ev(W.clauses(q))[0] == ["where I went and what I bought"]
    assert ev(W.statements_of(F.lit("What car did I buy last year?")))[0] == ["What car did I buy last year", "I buy last year car"]
    assert ev(W.statements_of(F.lit("When did I move?")))[0] == ["When did I move", "I move on a date"]
    assert ev(W.statements_of(F.lit("Hello")))[0] == ["Hello"]


def test_ghosts(ev):
    modes = W.ghost_modes(F.lit("What did I change before March?"))
    w = W.ghost_weights(modes)
    assert ev(modes, w["promote"], w["navigate"], W.ghost_budget(F.lit("x"), modes))[:] == (["temporal", "evolution"], 0.36, 0.65, 5)
    assert ev(W.ghost_budget(F.lit("Name three books"), modes))[0] == 12
    assert ev(W.ghost_score(one(), one(), F.lit(0.0), F.lit(0.3)), W.ghost_score(one(), one(), one(), F.lit(0.3)))[:] == (-1.0, 1.0)
    assert ev(W.may_promote(one(), F.lit(0.9), one(), one(), F.lit(True)), W.may_promote(one(), F.lit(0.96), one(), one(), F.lit(True)))[:] == (True, False)


def test_tethers(spark):
    m = lambda *p: [{"source": s, "value": v} for s, v in p]
    df = spark.createDataFrame([("q", 1, m((1, 0.2)), 0.1), ("q", 2, m((2, 0.9), (3, 0.1)), 0.5), ("q", 3, m((4, 0.1)), 0.0), ("r", 1, [], 0.0)], "q string, rank int, members array<struct<source:long,value:double>>, coverage double")
    assert [(r.q, r.sources) for r in W.capsule_tethers(df, "q", "rank", "members", "coverage").collect()] == [("q", [2])]


def test_ambiguous_pronouns(spark):
    rows = [(1, "Ann met Bo.", ["ann", "bo"]), (2, "She left.", []), (3, "Nobody came.", [])]
    df = spark.createDataFrame(rows, "i int, t string, s array<string>").withColumn("p", F.lit("x"))
    assert [r.i for r in W.ambiguous_references(df, "p", ["i"], "t", "s").collect()] == [2]


def test_answer_forms(spark, ev):
    assert A.normal_form("Ｓtraße, 5！") == "strasse 5" and A.normal_form(None) is None
    assert A.answer_leaves({"a": ["Nine lives", 9, None], "b": "x"}) == ["nine lives"]
    df = spark.createDataFrame([(1, '{"label": "correct", "reasoning": "ok"}'), (2, "it is WRONG, no: CORRECT"), (3, "?"), (4, None)], "i int, r string")
    assert [r[0] for r in df.select(A.judgement("r")).collect()] == ["CORRECT", "CORRECT", "PARSE_ERROR", "PARSE_ERROR"]
    assert ev(A.dialogue_ids(F.lit("D9:1 D4:4")), A.dialogue_ids(F.lit("s7")), A.dialogue_ids(F.lit("")))[:] == (["D4:4", "D9:1"], ["s7"], [])
    assert ev(A.leaf_strings(F.lit('{"a": [1, {"b": "x"}], "c": null}')))[0] == ["1", "x"]
    assert ev(A.goal_names(F.lit("Ann H. met X-ray Bo_2. at OPS-12 and 北京大学")))[0] == ["ann", "x-ray", "bo_2", "ops-12", "北京大学"]
    assert ev(A.parsed_date(F.lit("on 2025/2/30 or")), A.parsed_date(F.lit("x 2025-2-3")))[:] == (None, dt.date(2025, 2, 3))
