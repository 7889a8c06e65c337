"""Numbered statements: templates, versions, searches, rebuilt documents."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import statements as S


@pytest.fixture(scope="module")
def solve(spark):
    def run(texts, query, law, prefix=None):
        filler = "\n".join(f"{i}. Person {i} is a citizen of Country {i}." for i in range(1000, 1030))
        rows = [("c", i, t) for i, t in enumerate([*texts, filler])]
        src = spark.createDataFrame(rows, "corpus string, ord long, text string")
        facts = S.statement_facts(src, "corpus", "ord", "text")
        q = spark.createDataFrame([("c", 1, query, len(rows) if prefix is None else prefix)], "corpus string, query_id long, query string, prefix long")
        assert S.dense_corpora(facts, src, "corpus").count() == 1
        a = S.answer_questions(facts, q, law)
        return a.collect(), a, facts, src, q

    return run


def test_three_hops(solve):
    texts = ["1. Phoenix Inferno is associated with the sport of skyball.", "2. skyball was created in the country of Italy.", "3. The name of the current head of state in Italy is Sergio Mattarella."]
    for law in (S.SLINGSHOT, S.CLOSURE, S.SUPERPOSITION, S.ABSORBING):
        got = solve(texts, "Who is the head of state of the country where the sport of Phoenix Inferno was created?", law)[0]
        assert got[0].answer == "Sergio Mattarella" and got[0].primary == [2] and [p.split(" | ")[1] for p in got[0].path] == ["sport", "created_country", "head_state"], law.name


def test_later_statement_wins_and_the_older_one_stays_visible_before(solve):
    texts = ["5. The capital of Moria is Jerusalem.", "9. The capital of Moria is Taipei. \n10. Taipei is famous for tea."]
    got, a, facts, src, q = solve(texts, "What is the capital of Moria?", S.SUPERPOSITION)
    assert got[0].answer == "Taipei" and got[0].primary == [1]
    assert [r.object for r in S.superseded_answers(a, facts).collect()] == ["Jerusalem"]
    assert [r.ord for r in S.answer_echoes(a, src, q, "ord", "text", "corpus").collect()] == [1]
    assert solve(texts, "What is the capital of Moria?", S.CLOSURE, prefix=1)[0][0].answer == "Jerusalem"


def test_output_slot_beats_a_cue_on_the_way(solve):
    texts = ["1. The author of Red Book is Ann Lee.", "2. Ann Lee is married to Bo Ray.", "3. Bo Ray died in the city of Oslo.", "4. Ann Lee died in the city of Rome."]
    got = solve(texts, "Where did the spouse of the author of Red Book pass away?", S.CLOSURE)[0]
    assert got[0].answer == "Oslo" and got[0].relation == "died_city"


def test_nothing_wanted_or_named(solve, spark):
    assert solve(["1. The capital of Moria is Taipei."], "Tell me a story.", S.ABSORBING)[0] == []
    assert solve(["1. The capital of Moria is Taipei."], "What is the capital of Gondor?", S.CLOSURE)[0] == []
    plain = spark.createDataFrame([("c", 0, "Hello there."), ("c", 1, None)], "corpus string, ord long, text string")
    f = S.statement_facts(plain, "corpus", "ord", "text")
    assert f.count() == 0 and S.dense_corpora(f, plain, "corpus").count() == 0


def test_templates(spark):
    rows = [(i, words.replace("{s}", "Alpha Beta").replace("{o}", "Gamma Delta") + dot) for i, (_, words) in enumerate(S.TEMPLATES) for dot in (".", "")]
    got = spark.createDataFrame(rows, "i int, s string").select("i", S.parsed_statement("s").alias("f")).collect()
    assert all((r.f.subject, r.f.relation, r.f.object) == ("Alpha Beta", S.TEMPLATES[r.i][0], "Gamma Delta") for r in got)


def test_windows_give_back_their_documents(spark):
    stream = "".join(f"Document {i}: word{i} and some filler text for it. " for i in range(23))
    width, lap = 120, 40
    rows = [("c", n, stream[a : a + width]) for n, a in enumerate(range(0, len(stream) - lap, width - lap))]
    df = spark.createDataFrame(rows, "corpus string, ord long, text string")
    assert {r.overlap for r in S.common_overlaps(df, "corpus", "ord", "text").collect()} == {40}
    docs = {r.document: r for r in S.rebuilt_documents(df, "corpus", "ord", "text").collect()}
    assert len(docs) == 23
    for i in range(23):
        start = stream.index(f"Document {i}:")
        end = stream.index(f"Document {i + 1}:") if i < 22 else len(stream)
        assert docs[i + 1].windows == [n for n, a in enumerate(range(0, len(stream) - lap, width - lap)) if a < end and a + width > start]
