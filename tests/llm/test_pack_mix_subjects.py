"""Packing, mixing and subject areas."""

import random

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.mixing import MixConfig, mix_report, mix_sources
from palimpsest.llm.packing import PackingConfig, pack, pack_documents, packing_report
from palimpsest.llm.subjects import document_subjects, fit_subjects, predict, tokenize
from palimpsest.llm.tokens import with_token_counts


def test_packing_keeps_documents_whole(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([5, 40, 90, 130, 700])) for i in range(400)] + [(500, 0), (None, 9), (3, 40)]
    sizes[3] = (3, 40)
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id long, n_tokens long, capacity string")
    kinds = spark.createDataFrame([("small", 128), ("large", 512), ("none", None)], "container string, capacity_tokens int")
    out = pack_documents(df.drop("capacity"), kinds, PackingConfig(shard_tokens=10_000))
    rows = out.collect()
    for kind, cap in (("small", 128), ("large", 512)):
        mine = [x for x in rows if x.container == kind]
        used = {}
        for x in mine:
            used[x.sequence_id] = used.get(x.sequence_id, 0) + x.n_tokens
        assert max(used.values()) <= cap
        total = {}
        for x in mine:
            total.setdefault(x.doc_id, []).append(x)
        want = dict(s for s in sizes if s[0] is not None and s[1])
        assert {k: sum(x.n_tokens for x in v) for k, v in total.items()} == want
        assert all(len(v) == 1 for k, v in total.items() if want[k] <= cap)
        assert all(sum(x.n_tokens < cap for x in v) <= 1 for v in total.values())
    fill = {x.container: x.fill for x in packing_report(out, kinds).collect()}
    assert fill["large"] > 0.95
    assert pack_documents(df.limit(0).drop("capacity"), kinds).count() == 0


def test_pack_takes_the_cheapest_sequence_with_room():
    at = pack(np.array([10, 10, 4, 4]), 14, 0.1)
    assert at[0] != at[1] and {at[2], at[3]} == {at[0], at[1]}
    assert list(pack(np.array([], np.int64), 10, 0.1)) == []


def test_pack_equals_a_search_of_all_sequences():
    r = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(r.integers(5, 60))
        sizes = r.integers(1, capacity + 1, int(r.integers(1, 60)))
        room, cost = [capacity] * -(-int(sizes.sum()) // capacity), {}
        cost = [0.0] * len(room)
        want = [0] * len(sizes)
        for i in np.argsort(-sizes, kind="stable"):
            n = int(sizes[i])
            fits = [j for j in range(len(room)) if room[j] >= n]
            if not fits:
                fits = [len(room)]
                room.append(capacity)
                cost.append(0.0)
            j = min(fits, key=lambda j: (cost[j], j))
            want[i] = j
            room[j] -= n
            cost[j] += n + 0.01 * n * n
        assert list(pack(sizes, capacity, 0.01)) == want


def test_number_of_buckets_changes_no_mix(spark):
    df = spark.range(2000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source", "1 + id % 70 n_tokens")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 1)], "source string, target_share double, max_repeats int")
    one, many = ([tuple(r) for r in mix_sources(df, targets, MixConfig(bucket_rows=n)).collect()] for n in (10_000, 20))
    assert one == many


def test_mix_reaches_shares_and_caps_repeats(spark):
    df = spark.range(3000).selectExpr("id doc_id", "case when id % 30 = 0 then ' Rare ' when id % 3 = 0 then 'HOT' else 'other' end source", "1 + id % 50 n_tokens")
    df = df.unionByName(spark.createDataFrame([(9000, None, 5), (9001, "rare", 0), (9002, "unlisted", 5)], "doc_id long, source string, n_tokens long"))
    targets = spark.createDataFrame([("rare", 0.3, 2), ("hot", 0.5, 1), ("other", 0.1, 1), ("missing", 0.1, 4)], "source string, target_share double, max_repeats int")
    out = mix_sources(df, targets, MixConfig(bucket_rows=300))
    rep = {r.source: r for r in mix_report(out, targets).collect()}
    for s, share in (("rare", 3 / 9), ("hot", 5 / 9), ("other", 1 / 9)):
        assert rep[s].reached_share == pytest.approx(share, abs=0.02)
    assert rep["rare"].most_copies <= 2 and rep["hot"].most_copies == 1 and rep["missing"].tokens == 0
    rows = out.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    early = [sum(r.n_tokens for r in rows if r.source == "rare" and a <= r.position < a + 0.5) for a in (0, 0.5)]
    assert early[1] > early[0]
    assert mix_sources(df.limit(0), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "漢字" * 50000)], "n_tokens long, text string").withColumnRenamed("n_tokens", "id")
    got = {r.id: r.n_tokens for r in with_token_counts(df, ["id"], "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 50000


WORDS = {"sport": "goal referee penalty striker offside coach".split(), "law": "court statute verdict appeal clause tribunal".split(), "music": "guitar melody chorus drummer concert chord".split()}


def make(n, seed):
    r = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        subs = r.sample(list(WORDS), r.choice([0, 1, 1, 1, 2]))
        lines = [f"We noted the {r.choice(WORDS[s])} and then the {r.choice(WORDS[s])} again." for s in subs for _ in range(r.randrange(3, 6))] + ["Thanks, that is clear."] * r.randrange(0, 2)
        if not subs:
            lines = ["Thanks, that is clear.", "See you later."]
        r.shuffle(lines)
        about = {s for s in subs if 3 * sum(any(w in x for w in WORDS[s]) for x in lines) >= len(lines)}
        texts.append(" ".join(lines))
        truth.append(about)
    return texts, truth


def test_held_out_subjects():
    texts, truth = make(400, 1)
    r = random.Random(5)
    noisy = [{s for s in t if r.random() < 0.85} | ({r.choice(list(WORDS))} if r.random() < 0.04 else set()) for t in truth]
    keep = [i for i, n in enumerate(noisy) if n]
    model = fit_subjects(pa.array([texts[i] for i in keep]), pd.Series(["x"] * len(keep)), [noisy[i] for i in keep], sorted(WORDS))
    test, want = make(200, 2)
    y = predict(model, pa.array(test), pd.Series([None] * len(test)))
    got = [{model.subjects[k] for k in np.flatnonzero(row)} for row in y]
    tp, fp, fn = (sum(len(f(g, w)) for g, w in zip(got, want)) for f in (lambda g, w: g & w, lambda g, w: g - w, lambda g, w: w - g))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


def test_subject_tables(spark):
    texts, truth = make(120, 3)
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (902, texts[0] * 300, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, s) for i, t in enumerate(truth) for s in t] + [(900, "law"), (7777, "law"), (1, None)], "doc_id long, subject string")
    areas = spark.createDataFrame([(s,) for s in WORDS], "subject string")
    got = {(r.doc_id, r.subject) for r in document_subjects(docs, labels, areas).collect()}
    want = {(i, s) for i, t in enumerate(truth) for s in t}
    assert len(got & want) >= 0.95 * len(want) and not {d for d, _ in got} & {900, 901}
    assert document_subjects(docs, labels.limit(0), areas).count() == 0 and document_subjects(docs.limit(0), labels, areas).count() == 0


def test_tokenize_splits_sentences():
    t = tokenize(pa.array(["[session 3 | x]\nuser: A b. C d! 1.5 e", None, "", "你好。再见！"]))
    assert list(t.sentences) == [3, 0, 0, 2] and t.words[t.code[-1]] == "见" and list(t.lang) == [0, 0, 0, 2]
