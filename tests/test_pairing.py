"""Questions meet rows by shared words in blocks: all pairs count, and texts never travel with pairs."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import pairing as P
from palimpsest.plans import law_queries as Q

SF = "/root/testdata/sf0.001"


def _law(shared, q, m):
    return q["w"] * shared["a"] / (q["n_a"] + m["n_a"] - shared["a"]) + 0.5 * shared["b"] + m["v"]


@pytest.mark.parametrize("block", [3, 1000])
def test_best_by_law_is_brute_force(spark, block):
    r = random.Random(5)
    some = lambda letters: r.sample(letters, r.randrange(0, 4))
    q = [(r.choice(["x", "y", None]), i, some("abcdef"), some("uvw"), r.random()) for i in range(25)]
    m = [(r.choice(["x", "x", "y", "z", None]), i, some("abcdef"), some("uvw"), r.choice([0.0, 0.1, 0.2])) for i in range(60)]
    args = (spark.createDataFrame(q, "p string, q long, a array<string>, b array<string>, w double"), spark.createDataFrame(m, "p string, i long, a array<string>, b array<string>, v double"))
    got = sorted((x.q, x.i, x.s, x["rank"]) for x in P.best_by_law(*args, "p", "q", "i", ["a", "b"], _law, "s", 3, block=block).collect())
    want = []
    for p, i, a, b, w in q:
        score = lambda n, v: round(w * len({*a} & {*n[2]}) / len({*a} | {*n[2]}) + 0.5 * len({*b} & {*n[3]}) + v, 6)  # noqa: E731, B023
        rows = sorted((-score(n, n[4]), n[1]) for n in m if p and n[0] == p and {*a} & {*n[2]})[:3]
        want += [(i, j, -s, rank) for rank, (s, j) in enumerate(rows, 1)]
    assert got == sorted(want)
    none = args[0].limit(0)
    assert P.best_by_law(none, args[1], "p", "q", "i", ["a", "b"], _law, "s", 3).count() == 0


def test_halves_are_rounded_as_in_sql(spark):
    x = [0.313835, 0.157515, 0.264655, -0.313835, 2.5e-5, 0.0, 0.1234565, 17.12345]
    want = [duckdb.connect().execute(f"select round({v!r}::double, 5)").fetchall()[0][0] for v in x]
    assert list(P.rounded(np.array(x), 5)) == want
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(P.rounded_column(F.col("x"), 5)).collect()] == want


@pytest.mark.parametrize("name", ["planetary_retrieval", "cognitive_retrieval"])
def test_no_join_carries_pairs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not there")
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "explode(tok" not in plan


def test_items_of_a_text_by_one_expression(spark):
    r = random.Random(2)
    rows = [("".join(r.choice("AbZ09._:/- \n,é中😀") for _ in range(r.randrange(0, 12))),) for _ in range(3000)]
    rows += [("..Foo Bar. x-1: 3.2.1. 12, (v/2) Abc:1 _Foo Fo. 7",), ("",), (None,)]
    split = F.array_distinct(F.filter(F.split("t", T._ITEM_SPLIT), lambda w: F.rlike(w, F.lit(T.VALUE_ITEM))))
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~T.value_items("t").eqNullSafe(split)).count() == 0
    assert df.where("t like '..Foo%'").select(T.value_items("t")).first()[0] == ["Bar", "x-1", "3.2.1", "12", "v/2", "Abc:1"]
