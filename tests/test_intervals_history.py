"""Intervals and version history against brute force, and their edge cases."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.operators.history import fact_history, state_history
from palimpsest.operators.intervals import merge_intervals, period_gaps, periods_and_gaps

T0 = dt.datetime(2025, 1, 1)
FACTS = "fact_id long, tenant_id string, scope string, subject string, predicate string, object_value string, polarity int, asserted_at timestamp, extra string"
RECORDS = "tenant_id string, memory_id long, state string, snapshot_at timestamp, loaded_at timestamp, leaf long"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def brute_periods(rows):
    out = {}
    for k, a, b in rows:
        if a is not None and (b is None or b > a):
            out.setdefault(k, []).append((a, float("inf") if b is None else b))
    res = []
    for k, iv in out.items():
        iv.sort()
        merged = [list(iv[0])]
        for a, b in iv[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        res += [(k, "period", a, b) for a, b in merged] + [(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(res, key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5000)), st.one_of(st.none(), st.integers(0, 5000))), max_size=40))
def test_periods_match_brute_force(spark, rows):
    df = spark.createDataFrame([(k, at(a), at(b), "x") for k, a, b in rows], "k string, f timestamp, t timestamp, period_from string")
    secs = lambda h: -1 if h == float("inf") else int((T0 + dt.timedelta(hours=h)).replace(tzinfo=dt.timezone.utc).timestamp())
    want = sorted([(k, p, secs(a), secs(b)) for k, p, a, b in brute_periods(rows)], key=str)
    got = sorted([tuple(r) for r in periods_and_gaps(df, ["k"], "f", "t").collect()], key=str)
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 40), st.one_of(st.none(), st.integers(0, 60))), max_size=30))
def test_periods_are_stitched_over_many_slices(spark, rows):
    rows = [(k, a * 24, None if b is None else b * 24) for k, a, b in rows]
    df = spark.createDataFrame([(k, at(a), at(b), "x") for k, a, b in rows], "k string, f timestamp, t timestamp, period_from string")
    secs = lambda h: -1 if h == float("inf") else int((T0 + dt.timedelta(hours=h)).replace(tzinfo=dt.timezone.utc).timestamp())
    want = sorted([(k, p, secs(a), secs(b)) for k, p, a, b in brute_periods(rows)], key=str)
    assert sorted([tuple(r) for r in periods_and_gaps(df, ["k"], "f", "t", slice_days=3).collect()], key=str) == want


def test_hot_key_and_repeats_merge_into_one_period(spark):
    df = spark.range(4000).selectExpr("'hot' k", "timestamp'2020-01-01' + make_interval(0,0,0,0,id) f", "timestamp'2020-01-01' + make_interval(0,0,0,0,id+1) t")
    out = merge_intervals(df.unionByName(df), ["k"], "f", "t").collect()
    assert len(out) == 1 and out[0].period_to - out[0].period_from == dt.timedelta(hours=4000)
    assert period_gaps(merge_intervals(df, ["k"], "f", "t"), ["k"]).count() == 0


def brute_versions(rows):
    """rows: (key, at, tie, value or None) -> versions."""
    out = []
    for k in {r[0] for r in rows}:
        own = sorted({r[1:] for r in rows if r[0] == k}, key=lambda r: (r[0], r[1], "x" if r[2] is None else "v" + r[2]))
        held = "start"
        steps = []
        for a, _, v in own:
            if v != held:
                steps.append((a, v))
                held = v
        out += [(k, v, a, steps[i + 1][0] if i + 1 < len(steps) else None) for i, (a, v) in enumerate(steps) if v is not None]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_fact_history_matches_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        key = r.choice(["ann", "bob", "cy"])
        rows.append((i, "t", None, key, "p", r.choice(["A", " a ", "b", "C", None]), r.choice([1, 1, 1, -1, None]), at(r.randrange(4000)), "x"))
    rows += rows[:50]
    rows += [(900, "t", None, None, "p", "z", 1, at(1), "x"), (901, "t", None, "ann", "p", "z", 1, None, "x")]
    r.shuffle(rows)
    got = sorted([(x.subject, x.held_value, x.from_at, x.to_at) for x in fact_history(spark.createDataFrame(rows, FACTS)).collect()], key=str)
    want = brute_versions([(s, t, i, o.strip().lower() if p != -1 else None) for i, _, _, s, _, o, p, t, _ in rows if s and o is not None and t is not None])
    assert got == want


def test_state_history_last_load_counts_and_gaps_change_nothing(spark):
    rows = [
        ("t", 1, "stable", at(0), at(1), 7), ("t", 1, "Stable ", at(48), at(49), 7), ("t", 1, None, at(96), at(97), 7), ("t", 1, "archived", at(24), at(30), 7), ("t", 1, "stable", at(24), at(40), 7),
        ("t", 1, "floating", at(120), at(121), 7), ("t", 1, "floating", at(120), at(121), 7), ("t", 2, " ", at(0), at(1), 7), ("t", None, "stable", at(0), at(1), 7), ("t", 3, "stable", None, at(1), 7),
    ]
    got = sorted([(x.entity, x.held_value, x.from_at, x.to_at) for x in state_history(spark.createDataFrame(rows, RECORDS)).collect()])
    assert got == [("1", "floating", at(120), None), ("1", "stable", at(0), at(120))]


def test_empty_tables(spark):
    assert fact_history(spark.createDataFrame([], FACTS)).count() == 0
    assert state_history(spark.createDataFrame([], RECORDS)).count() == 0
    assert periods_and_gaps(spark.createDataFrame([], "k string, f timestamp, t timestamp"), ["k"], "f", "t").count() == 0
