"""Retrieval operators against brute force, and the layering of the packages."""

import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval as R


def test_overlap_join_matches_brute_force(spark):
    r = random.Random(4)
    a, b = ([(r.choice("xy"), s := r.randrange(300), s + r.randrange(0, 60)) for _ in range(60)] for _ in range(2))
    df = lambda rows: spark.createDataFrame(rows, "k string, start int, end int")
    got = sorted((x.k, x.start, x.end, x.r_start, x.r_end) for x in R.overlap_join(df(a), df(b), ["k"], 25).collect())
    want = sorted((k, s, e, t, f) for k, s, e in a for m, t, f in b if k == m and s < e and t < f and t < e and s < f)
    assert got == want
    assert R.overlap_join(df(a).limit(0), df(b), ["k"], 25).count() == 0


def test_grounding_and_slugs(spark):
    df = spark.createDataFrame([("The  Old\nhouse", "old HOUSE"), ("x", ""), (None, "a"), ("a", None), ("abc", "d")], "s string, e string")
    assert [r[0] for r in df.select(R.grounded(F.col("s"), F.col("e"))).collect()] == [True, False, False, False, False]
    p = spark.createDataFrame([(" Lives in ",), ("",), (None,), ("!!",)], "p string")
    assert [r[0] for r in p.select(R.predicate_slug(F.col("p"))).collect()] == ["lives_in", "related_to", "related_to", "related_to"]


def test_directives(spark):
    df = spark.createDataFrame([("Always use markdown",), ("I prefer short answers",), ("The box is red",), ("",), (None,)], "t string")
    got = [(r.a, r.b) for r in df.select(R.directive_role("t").alias("a"), R.directive_family("t").alias("b")).collect()]
    assert got[:4] == [("instruction", "format"), ("preference", "response_style"), (None, "topic:box_red"), (None, "general")]


def test_force_and_feedback(spark):
    assert spark.range(1).select(R.force({k: F.lit(1.0) for k in R.FORCE})).first()[0] == pytest.approx(1.0)
    w = R.feedback_weights({"a": 0.3, "b": 0.6}, {"a": 1.0, "b": 1.0}, [{"a": 0.0, "b": 0.0}, {"a": 1.0}])
    assert w == {"a": pytest.approx(0.3175), "b": 0.60} and R.feedback_weights({"a": 0.02}, {}, [{"a": 1.0}]) == {"a": 0.01}


def test_hits_and_places_around_them(spark):
    rows = spark.createDataFrame([("g", i) for i in range(1, 11)] + [("h", 1)], "g string, o int")
    assert sorted(r.o for r in R.around(spark.createDataFrame([("g", 1), ("g", 9)], "g string, o int"), rows, "g", "o", 2).collect()) == [1, 2, 3, 7, 8, 9, 10]


def test_core_does_not_import_the_text_subpackage():
    root = pathlib.Path(__file__).parent.parent / "palimpsest"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"palimpsest\.llm|from \.+llm", p.read_text()), p
