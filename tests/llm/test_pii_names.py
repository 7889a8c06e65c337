"""Personal data and name spellings."""

import pytest

from palimpsest.llm.names import IMPOSSIBLE, NEW_ENTITY, channel, log_likelihood, link_spellings, parse_name, spelling_pairs
from palimpsest.llm.pii import Segment, best_segments, find_segments, pii_items, redact_text, redacted
from palimpsest.llm.pii_training import _CARRIERS, generate, trained_weights


@pytest.fixture(scope="module")
def weights():
    return trained_weights()


def test_generated_accuracy(weights):
    tp = fp = fn = 0
    for text, truth in generate(800, 4242):
        got = {Segment(a, b, k) for k, _, a, b in find_segments(text, weights)}
        tp, fp, fn = tp + len(got & set(truth)), fp + len(got - set(truth)), fn + len(set(truth) - got)
    assert tp / (tp + fp) >= 0.97 and tp / (tp + fn) >= 0.96


# Written by hand, apart from the grammar that trains the field: text with the items in brackets after a type.
WRITTEN = """
Yesterday [N:Maria de la Cruz] dropped off the keys.
[N:Jan van der Berg] has resigned, which nobody expected.
The invitation was for [N:Mary-Jane Watson] and her sister.
Please contact [N:王伟] at [P:13812345678].
Отдайте пропуск [N:Ивану Петрову] до вечера.
if anything breaks call [P:5551234]
you can mail me at [E:john DOT smith AT acme DOT com] or not at all
Shipping label: [N:Robert K. Hale], [A:17 Juniper Lane], Fort Wayne.
We are now at [A:Calle Mayor 12], right above the bakery.
Her mailbox [E:h.lindqvist@uni-web.example] bounces since Tuesday.
The clerk typed [I:078-05-1120] into the social security field.
Passport [I:X1234567] expires in 2031.
[N:O'Brien, Sean] owes us two signatures.
Fax the contract to [P:(212) 555-0187] before noon.
Our neighbours at [A:Lindenstraße 44b] complained about the noise.
The parcel for [N:Elena García] waits at the counter.
Dial [P:+44 20 7946 0958] and ask for the night desk.
[N:Thomas Müller] plays for Bayern.
contact=[E:ops.team@example.org]
She moved from [A:Flat 9, 221B Baker Street] to the coast.
The build 12.4.118 finished in 48 minutes.
Berlin, Hamburg and Munich were cold.
Acme Robotics Ltd bought Northwind Foods.
Order 8841-22-17 shipped on 2024-05-01.
Chapter 12 explains why Newton was wrong.
Commit 88412217301 broke the nightly run.
Golden Gate Bridge is painted again.
See Table 4 and Figure 12 for details.
Windows Server 2019 needs a restart.
The Monday Meeting was moved to April 12.
我们周末去爬山，方法很简单。
""".strip().splitlines()


def test_sentences_written_by_hand(weights):
    import re

    types = {"N": "NAME", "P": "PHONE", "E": "EMAIL", "I": "ID", "A": "ADDRESS"}
    right = found = wanted = 0
    for line in WRITTEN:
        want = {(types[k], v) for k, v in re.findall(r"\[([NPEIA]):([^\]]+)\]", line)}
        got = {(k, v) for k, v, _, _ in find_segments(re.sub(r"\[[NPEIA]:([^\]]+)\]", r"\1", line), weights)}
        right, found, wanted = right + len(want & got), found + len(got), wanted + len(want)
    assert right / wanted >= 0.9 and right / found >= 0.9


def test_no_training_sentence_stands_in_the_tables():
    import glob
    import re

    import duckdb

    files = [f for t in ("memory_writes", "fact_frames") for f in glob.glob(f"/root/testdata/sf0.001/{t}.parquet")]
    if not files:
        pytest.skip("test tables are not there")
    column = {"memory_writes": "text", "fact_frames": "evidence"}
    text = "\n".join(r[0] for f in files for r in duckdb.sql(f"select {column[f.rsplit('/', 1)[1][:-8]]} from '{f}'").fetchall() if r[0])
    pieces = [p.strip(" .,:;") for p in re.split(r"\{\w+\}|\||\n", _CARRIERS)]
    assert [p for p in pieces if len(p.split()) >= 3 and p in text] == []


def test_best_segments_is_optimal():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(60):
        segs = [Segment(a := r.randrange(30), a + r.randrange(1, 8), r.choice("AB")) for _ in range(7)]
        sc = [r.uniform(-1, 2) for _ in segs]
        best = max(
            (sum(sc[i] for i in c) for n in range(8) for c in itertools.combinations(range(7), n) if all(segs[i].end <= segs[j].start or segs[j].end <= segs[i].start for i, j in itertools.combinations(c, 2))),
            default=0,
        )
        got = best_segments(segs, sc)
        assert sum(max(s for g, s in zip(segs, sc) if g == x) for x in got) == pytest.approx(best) or sum(sc[segs.index(x)] for x in got) == pytest.approx(best)


def test_kinds_and_redaction(weights):
    text = "Emergency contact: Dr. Priya Faezirn (+1 926 555 0117). Send the box to Flat 3, 12 Old Kegroan Lane, Mills. Passport or ID on file for Faezirn, Priya: QQ 61 29 93 A. Write to p.faezirn (at) mail dot example. Checksum 61882772 matches."
    out = redact_text(text, weights)
    assert out == "Emergency contact: Dr. [NAME] ([PHONE]). Send the box to [ADDRESS], Mills. Passport or ID on file for [NAME]: [ID]. Write to [EMAIL]. Checksum 61882772 matches."
    assert redact_text("", weights) == ""


def test_stored_characters_come_out(weights):
    got = find_segments("Emergency contact: Рriyа Faezirn (０７７００ 900396).", weights)
    assert [(k, t) for k, t, _, _ in got] == [("NAME", "Рriyа Faezirn"), ("PHONE", "０７７００ 900396")]


def test_pii_tables(spark, weights):
    df = spark.createDataFrame([(1, "Contact mail: a.b@example.com and a.b@example.com", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30000 + "Contact mail: c.d@example.com", "x"), (1, "Contact mail: a.b@example.com and a.b@example.com", "x")], "id long, text string, pii_text string")
    got = sorted((r.id, r.pii_text) for r in pii_items(df.drop("pii_text"), ["id"], "text", weights).distinct().collect())
    assert got == [(1, "a.b@example.com"), (4, "c.d@example.com")]
    red = {r.id: r.redacted for r in redacted(df, ["id"], "text", weights).collect()}
    assert red[2] is None and red[3] == "" and red[4].endswith("[EMAIL]")
    assert pii_items(df.limit(0), ["id"], "text", weights).count() == 0


SAME = [
    ("William Zoumaent", "Bill Zoumtent"), ("Quaicriack, Williaam", "William Quaicriack"), ("Leonard T. Sadaerm", "Leonard Sadaorm"), ("Mx Beikias", "Vincent Beikias"), ("HARUKA LAESKUKLAEL", "Haruka  Laeskuklael"),
    ("Stotaer Dmitri", "Dima Stotaer"), ("Huskior Signal Instruments Ltd", "Huskior Signal Inst."), ("MJR GmbH", "Muduflurk Juniper Robotics, G.m.b.H."), ("M.J.R.", "muduflurk juniper robotics"),
    ("Cobalt Logistics, Weitothon", "Weitothon Cobalt-Logistics"), ("The Piacarm Ember Publishing", "Piacarm Ember Publishing Co"), ("Pafladioln W. Holdings", "Pafladioln Willow Holdings Corporation"), ("O. Skiriwiam", "Oluwaseun Skeiriwiam"),
    ("Acme Foods", "Acme Foods Ltd"), ("李明", "李 明"), ("欧阳 娜", "欧阳娜"), ("Northwind Traders", "Northwind Traders Inc."),
]
OTHER = [("Katherine Beplerd", "Samuel Beplerd"), ("K. Beplerd", "S. Beplerd"), ("Robert A. Voss", "Robert B. Voss"), ("Jon Maep", "Jo Maep"), ("Zoaflesk Lattice Publishing", "Zoaflesk Copper Foods"), ("MJR", "MKR")]


@pytest.mark.parametrize("a,b", SAME)
def test_variants_are_likely(a, b):
    assert log_likelihood(channel(parse_name(a), parse_name(b))) > NEW_ENTITY
    assert log_likelihood(channel(parse_name(b), parse_name(a))) > NEW_ENTITY


@pytest.mark.parametrize("a,b", OTHER)
def test_others_are_not(a, b):
    assert channel(parse_name(a), parse_name(b)) == channel(parse_name(b), parse_name(a)) == IMPOSSIBLE


@pytest.mark.parametrize("name", ["user", "our vendor", "team lead", "", "  ", "Planner 4", "Brareilm Indexer 2", "a@b.c", "..."])
def test_no_names(name):
    assert parse_name(name).kind == ""


def test_linking(spark):
    names = [("Vincent Beikias", 5), ("Viincent Beikias", 9), ("Beikias, V.", 2), ("Katherine Beplerd", 3), ("Samuel Beplerd", 2), ("K. Beplerd", 1), ("user", 50), ("", 3)]
    rows = [("t", s, n, c) for s in ("a", None) for n, c in names] + [("t", "b", "Vincent Beikias", 1)]
    df = spark.createDataFrame(rows, "tenant_id string, scope string, name string, n long")
    listed = spark.createDataFrame([], "tenant_id string, scope string, a string, b string")
    pairs = spelling_pairs(link_spellings(df, listed, ["tenant_id", "scope"]), ["tenant_id", "scope"]).collect()
    want = {("Beikias, V.", "Viincent Beikias"), ("Beikias, V.", "Vincent Beikias"), ("Viincent Beikias", "Vincent Beikias"), ("K. Beplerd", "Katherine Beplerd")}
    assert {(p.name_a, p.name_b) for p in pairs if p.scope == "a"} == want == {(p.name_a, p.name_b) for p in pairs if p.scope is None}
    assert not [p for p in pairs if p.scope == "b"]
    assert link_spellings(df.limit(0), listed, ["tenant_id", "scope"]).count() == 0


def test_a_known_name_is_a_slip_of_another_only_where_counts_speak_for_it(spark):
    rows = [("t", "a", "John Smith", 40), ("t", "a", "Jon Smith", 1), ("t", "b", "John Smith", 3), ("t", "b", "Jon Smith", 3)]
    df = spark.createDataFrame(rows, "tenant_id string, scope string, name string, n long")
    listed = spark.createDataFrame([], "tenant_id string, scope string, a string, b string")
    pairs = spelling_pairs(link_spellings(df, listed, ["tenant_id", "scope"]), ["tenant_id", "scope"]).collect()
    assert [(p.scope, p.name_a, p.name_b) for p in pairs] == [("a", "John Smith", "Jon Smith")]


def test_a_family_name_shared_by_many_makes_no_block(spark):
    from palimpsest.llm.names import block_keys

    keys = [set(block_keys(parse_name(x))) for x in ("Katherine Beplerd", "Robert Beplerd", "Mx Beplerd")]
    assert all(k.endswith("*") for k in keys[0] & keys[1])
    assert {k[1:] for k in keys[2]} == {k[1:] for k in keys[0] if k.endswith("*")}
