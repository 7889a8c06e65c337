"""Learned scores against plain Python, greedy choices, reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ledger, selection
from palimpsest.operators import learning as N


def test_gate_learns_what_is_useful(spark):
    good, bad = [0.9, 0.8, 0.5, 0, 0.9, 0.4, 0.3, 0.1, 0.0], [0.0, 0.1, 0, 0, 0.4, 0, 0, 0.9, 0.8]
    w, b = N.learned_gate([(good, False), (bad, True)] * 60)
    old_w, old_b = N.learned_gate([])
    fields = dict(zip(N.GATE_WEIGHTS, map(F.lit, map(float, bad))))
    after, before = spark.range(1).select(N.gate_probability(fields, w, b), N.gate_probability(fields, old_w, old_b)).first()
    assert after > before and all(abs(x) <= 4 for x in w) and old_w == list(N.GATE_WEIGHTS.values())


def test_reranker_scores_in_the_jvm_as_in_python(spark):
    r = N.PairwiseReranker()
    up, down = [0.9, 0.5, 0.6, 1, 1, 0.8, 0.3], [0.1, 0.1, 0.1, 0, 0, 0.5, 0.0]
    gap = lambda: r._forward(np.array(up))[1] - r._forward(np.array(down))[1]
    first = gap()
    for _ in range(50):
        r.learn(up, [down])
    assert gap() > first
    s = spark.range(1).select(r.score(dict(zip(N.RERANK_FIELDS, map(F.lit, map(float, up)))))).first()[0]
    assert s == pytest.approx(r._forward(np.array(up))[1])
    q = spark.createDataFrame([("fix AB-12 now", "please fix AB-12 today")], "q string, t string")
    x = q.select(*[c.alias(k) for k, c in N.rerank_fields("q", "t", F.lit(0.5)).items()]).first()
    assert x.identifier == 1.0 and x.polarity == 1.0 and 0 < x.pairs <= 1 and x.overlap > 0


def test_orbit_model_separates(spark):
    rows = [([float(i % 10) / 10, 1.0], int(i % 10 > 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "f array<double>, y int")
    m = N.fit_orbit_model(df, "f", "y", F.lit(False))
    assert m.coefficients[0] > 1


def test_capsule_recall_and_merging(spark):
    caps = spark.createDataFrame([("q", 1, [1, 2]), ("q", 2, [3]), ("r", 1, [9])], "q string, rank int, s array<long>")
    gold = spark.createDataFrame([("q", 2), ("q", 3), ("r", 5), ("n", 1)], "q string, id long")
    got = {r.k: (r.queries, r["any"], r.full, r.micro, r.mrr) for r in N.capsule_recall(caps, gold, "q", "rank", "s", "id", [1, 2]).collect()}
    third = round(1 / 3, 6)
    assert got == {1: (3, third, 0.0, 0.25, third), 2: (3, third, third, 0.5, third)}
    parts = spark.createDataFrame([("a", 10, 0.5), ("a", 30, 0.9), ("b", 0, 1.0)], "c string, n long, v double")
    assert [(r.c, r.n, round(r.v, 6)) for r in N.merged_results(parts, "n", ["c"], ["v"]).collect()] == [("a", 40, 0.8)]


def test_answers_and_options(spark):
    rows = [("Red fox", "red  fox!", True, [1], [1, 2], [1]), ("a fox", "red fox", True, [3], [1], []), ("I don't know", None, False, [], [], []), ("Oslo", None, False, [], [4], [5])]
    r = N.answer_report(spark.createDataFrame(rows, "prediction string, answer string, answerable boolean, evidence array<int>, hits array<int>, citations array<int>")).first()
    assert (r.cases, r.exact, r.token_f1, r.evidence_recall, r.grounded, r.abstention) == (4, 0.25, 0.375, 0.75, 0.5, 0.5)
    o = spark.createDataFrame([("q", 1, 0.2), ("q", 0, 0.2), ("q", 2, 0.1)], "q string, o int, s double")
    assert [x.o for x in N.best_option(o, "q", "o", F.col("s"), F.lit(0.0), F.lit(0.0)).collect()] == [0]


def test_capsules_cover_goals_and_anchors_differ(spark):
    s = "q string, id int, rel double, g array<int>, e array<string>, t array<string>, s array<int>, trust double"
    df = spark.createDataFrame([("q", 1, 0.50, [0], ["a"], ["x"], [1], 1.0), ("q", 2, 0.49, [0], ["a"], ["x"], [1], 1.0), ("q", 3, 0.45, [1], ["b"], ["y"], [2], 1.0), ("q", 4, 0.1, [2], [], [], [3], 1.0)], s)
    out = selection.capsules(df, "q", "id", "rel", "g", "e", "t", "s", "trust", pool=None).orderBy("place").collect()
    assert [r.id for r in out] == [1, 3, 2]
    a = spark.createDataFrame([("q", 1, 1, 0.9, 0.5, [1]), ("q", 1, 2, 0.9, 0.5, [1, 2]), ("q", 2, 3, 0.8, 0.5, [2]), ("q", 2, 4, 0.8, 0.4, [2, 7])], "q string, a int, id int, own double, mean double, s array<int>")
    assert [r.id for r in selection.anchored(a, "q", "a", "id", "own", "mean", "s").orderBy("place").collect()] == [2, 4]


def test_json_leaves_of_any_depth(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":[1,{"g":"x"}]}}}}},"z":""}'
    df = spark.createDataFrame([(1, deep), (2, "no json"), (3, None)], "i int, j string")
    assert sorted((r.path, r.value) for r in ledger.json_leaves(df, "i", "j").collect()) == [("a.b.c.d.e.f[0]", "1"), ("a.b.c.d.e.f[1].g", "x")]
