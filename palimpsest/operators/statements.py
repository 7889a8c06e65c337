"""Graphs of numbered statements: sentence templates, versions by number, bounded searches that answer a question.

A statement is a line ``n. sentence``; templates turn it into subject, relation and object. The edge of a subject and
relation is its last visible statement. A question names anchors (subjects) and wanted relations; paths from the anchors
are extended hop by hop as joins, one best path per search state, and end at an edge of a wanted relation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.answers import word_form
from palimpsest.functions.text import _once
from palimpsest.session import materialize

# Sentences and the relations they tell, in the order in which they are tried; {s} and {o} stand for names.
TEMPLATES: list[tuple[str, str]] = [
    ("music", "The type of music that {s} plays is {o}"), ("author", "The author of {s} is {o}"), ("capital", "The capital of {s} is {o}"),
    ("educated_at", "The university where {s} was educated is {o}"), ("educated_at", "The univerisity where {s} was educated is {o}"), ("produced_by", "The company that produced {s} is {o}"),
    ("ceo", "The chief executive officer of {s} is {o}"), ("head_state", "The name of the current head of state in {s} is {o}"), ("head_government", "The name of the current head of the {s} government is {o}"),
    ("head_government", "The name of the current head of government in {s} is {o}"), ("head_coach", "The head coach of {s} is {o}"), ("headquarters_city", "The headquarters of {s} is located in the city of {o}"),
    ("official_language", "The official language of {s} is {o}"), ("original_language", "The original language of {s} is {o}"), ("director", "The director of {s} is {o}"), ("chairperson", "The chairperson of {s} is {o}"),
    ("child", "{s}'s child is {o}"), ("born_city", "{s} was born in the city of {o}"), ("died_city", "{s} died in the city of {o}"), ("founded_city", "{s} was founded in the city of {o}"),
    ("founded_by", "{s} was founded by {o}"), ("developed_by", "{s} was developed by {o}"), ("created_country", "{s} was created in the country of {o}"), ("created_by", "{s} was created by {o}"),
    ("performed_by", "{s} was performed by {o}"), ("written_language", "{s} was written in the language of {o}"), ("married", "{s} is married to {o}"), ("sport", "{s} is associated with the sport of {o}"),
    ("religion", "{s} is affiliated with the religion of {o}"), ("citizen", "{s} is a citizen of {o}"), ("continent", "{s} is located in the continent of {o}"), ("position", "{s} plays the position of {o}"),
    ("speaks_language", "{s} speaks the language of {o}"), ("works_field", "{s} works in the field of {o}"), ("employed_by", "{s} is employed by {o}"), ("famous_for", "{s} is famous for {o}"),
    ("worked_city", "{s} worked in the city of {o}"), ("original_broadcaster", "The original broadcaster of {s} is {o}"), ("original_broadcaster", "The origianl broadcaster of {s} is {o}"),
    ("head_government", "The Prime Minister of {s} is {o}"), ("head_state", "The President of {s} is {o}"), ("head_government", "The Governor of {s} is {o}"), ("head_government", "The Mayor of {s} is {o}"),
]
# Words of a question that speak of a relation.
CUES: dict[str, list[str]] = {
    "music": ["music", "genre"], "author": ["author", "wrote", "written by"], "capital": ["capital"], "educated_at": ["educated", "university", "school"], "produced_by": ["produced", "manufacturer", "company"],
    "ceo": ["chief executive", "ceo"], "head_state": ["head of state", "chief public representative"], "head_government": ["head of government", "government leader"], "head_coach": ["head coach", "coach"],
    "headquarters_city": ["headquarters"], "official_language": ["official language", "language is recognized", "language is used"], "original_language": ["original language"], "director": ["director"],
    "chairperson": ["chairperson", "chairman", "chairwoman"], "child": ["child", "son", "daughter"], "born_city": ["birthplace", "born"], "died_city": ["died", "death"],
    "founded_city": ["come into existence", "founded in", "origin city"], "founded_by": ["founder", "founded by", "who founded"], "developed_by": ["developed", "developer"],
    "created_country": ["country where", "country did", "country of origin", "originated", "originally hail", "came from"], "created_by": ["creator", "created by"],
    "performed_by": ["performer", "performed", "sang", "singer"], "written_language": ["written language", "written in"], "married": ["spouse", "married", "wife", "husband"], "sport": ["sport"],
    "religion": ["religion", "faith"], "citizen": ["citizen", "citizenship", "nationality"], "continent": ["continent"], "position": ["position"], "speaks_language": ["speaks", "spoken language"],
    "works_field": ["occupation", "profession", "works in", "field of"], "employed_by": ["employed", "employer", "works for"], "famous_for": ["famous", "known for"],
}
# What a question asks for, in order. A line is: relations: alternatives; in an alternative, "a .. b" means
# that b follows a somewhere, and words of the same place are given once for each spelling.
SLOTS = """
continent: which continent, what continent, to which continent, continent of origin
died_city: pass away, passed away, died, death
capital: capital, capital city
created_country: which country .. sport, which country .. origin, which country .. birthplace, which country .. come from, which country .. came from, what country .. sport, what country .. origin, what country .. birthplace, what country .. come from, what country .. came from, from which country .. sport, from which country .. origin
born_city created_country: birthplace, born in
worked_city: work location, location of work, city .. work, city .. worked, where .. work, where .. worked
official_language: official language, language is recognized, language is used
original_language: original language
written_language original_language: written .. language, work .. language, book .. language, notable work .. language, what language
religion: religious affiliation, religion, faith
sport: what sport, which sport, sport that
position works_field: job title, playing position, which position, what position
works_field: occupation, profession, field of work, work in which field, works in which field
head_state: chief of state, head of state, chief public representative
head_government: head of government, government leader, prime minister
head_government head_state: chief executive .. country, chief executive .. government, country .. chief executive, government .. chief executive
ceo: chief executive officer, ceo
head_coach: head coach, coach
headquarters_city: headquarters
original_broadcaster: original broadcaster, origianl broadcaster, broadcaster
child: child category, name of the child, whose child
author: author, written by, who wrote
director: director
chairperson: chairperson, chairman, chairwoman
performed_by: performer, singer, performed by
developed_by: developer, developed by
produced_by: producer, produced by, manufacturer
founded_by: founder, founded by, who founded
created_by: creator, created by
married: spouse, married, wife, husband
citizen: citizenship, nationality, citizen of
"""
# What the head of a question asks for, in order, as above.
HEADS = """
official_language: which language .. official, what language .. official, in which language .. official, which language .. government, what language .. government
speaks_language: which language .. speak, what language .. speak, in which language .. speak, which language .. spoken, what language .. spoken, what language .. write, what language .. sign
written_language original_language: language of the work, language of work, language of the book, language of the novel, work .. written in, book .. written in, novel .. written in
citizen: which country .. citizenship, what country .. citizenship, which country .. citizen, what country .. citizen, which nation .. citizenship, what country .. nationality, hold citizenship, holds citizenship
created_country: which country .. created, what country .. created, from which country .. came from, which country .. originated, what country .. originated, which country .. founded, which country .. come from, which country .. came from
died_city: which city .. died, what city .. died, in what city .. die, which place .. died, where .. die, where .. died, where .. pass away, where .. passed away
born_city: which city .. born, what city .. born, which city .. birth, where .. born
founded_city: which city .. founded, what city .. founded, which place .. founded, where was .. founded, place of origin
founded_by: who .. founded, who .. established, which person .. founded, name of the person .. founded
famous_for: significant creation, notable creation, notable work, famous work, known for, famous for
head_government: head of the government, head of government, current head of the .. government, government leader, government chief executive
head_state: head of state, chief public representative
capital: seat of government, center of government, centre of government, capital city
educated_at: educational institution, educational organization, which school, which university, in which school
director: directed or managed, who directed, person who directed
headquarters_city: headquarter, headquarters
worked_city: location of work, place of work, work location, where .. work, where .. worked
works_field: what kind of work, occupation, profession, field of work
written_language: notable work .. language, notable work .. written, language .. notable work, written .. notable work
died_city: die, dies, died, dying, death, pass away, passed away
"""
# Further heads of the absorbing search.
ABSORBING_HEADS = """
founded_city: place .. established, place .. founded, city .. founded, city .. established, location .. founded, where .. founded, where .. established
married: partner of, wife of, husband of, spouse of
head_state: report to, reports to, reported to, highest-ranking official, chief of state
head_government: prime minister, leader of the government, leader of government, government leader, head of government, head of the .. government
headquarters_city: head office, office of the company, office of the organization, currently headquartered, operate from
official_language: proceedings .. language, official medium .. language, officially spoken .. language, primary language, language .. proceedings, language .. official medium, language .. officially spoken
speaks_language: language .. fluent, language .. speaking, language .. spoken, language .. signed, fluent .. language, speaking .. language, spoken .. language
died_city: place of demise, where .. breathed .. last
ceo chairperson: leads .. company, lead .. company, in charge of .. company, in charge of .. organization, leads .. organization, highest-ranking official of .. company
"""


def _rules(table: str) -> list[tuple[list[str], str]]:
    """(relations, pattern over lower-case text) of each line; RE2 and Java read the pattern alike."""
    out = []
    for line in table.strip().splitlines():
        names, words = line.split(": ", 1)
        ways = [".*".join(r"\b" + re.escape(p.strip()).replace(r"\ ", " ") + r"\b" for p in w.split("..")) for w in words.split(",")]
        out.append((names.split(), "|".join(ways)))
    return out


def _template(words: str) -> str:
    """Pattern of a sentence; both names hold more than blanks and dots."""
    some = r"(.*?[^\s.].*?)"
    return "^" + re.escape(words).replace(r"\ ", " ").replace(r"\{s\}", some).replace(r"\{o\}", some) + r"\.?$"


def parsed_statement(sentence: Column | str) -> Column:
    """struct(subject, relation, object) by the first template that fits; null where none does.

    The template is found first, by its number, so that names are cut out once.
    """
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    number = F.when(F.lit(False), F.lit(0))
    for i, (_, words) in enumerate(TEMPLATES, 1):
        number = number.when(F.rlike(s, F.lit(_template(words))), i)
    rules = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(_template(w)).alias("pattern")) for r, w in TEMPLATES])

    def cut(n: Column) -> Column:
        rule = F.element_at(rules, n)
        part = lambda i: F.regexp_replace(F.trim(F.call_function("regexp_extract", s, rule["pattern"], F.lit(i))), r"\.+$", "")
        return F.when(n.isNotNull(), F.struct(part(1).alias("subject"), rule["relation"].alias("relation"), part(2).alias("object")))

    return _once(number, cut)


def statement_facts(sources: DataFrame, corpus: str, ord_col: str, text: str) -> DataFrame:
    """(corpus, ordinal, statement, subject, relation, object, sources): facts of numbered lines, once per number and wording.

    ``sources`` lists the places of the texts that tell the fact, in order. Lines without a number or a fitting template
    tell nothing.
    """
    lines = sources.where(F.col(text).isNotNull()).select(F.col(corpus).alias("corpus"), F.col(ord_col).alias("ord"), F.explode(F.split(text, r"\r?\n")).alias("line"))
    told = lines.select("corpus", "ord", F.try_to_number(F.regexp_extract("line", r"^\s*(\d{1,18})\.\s*(.+?)\s*$", 1), F.lit("9" * 18)).cast("long").alias("ordinal"), F.regexp_extract("line", r"^\s*(\d{1,18})\.\s*(.+?)\s*$", 2).alias("sentence"))
    told = told.where("ordinal is not null").withColumn("f", parsed_statement("sentence")).where("f is not null")
    return told.groupBy("corpus", "ordinal", word_form("sentence").alias("statement")).agg(
        F.min_by("f", "ord").alias("f"), F.array_sort(F.collect_set("ord")).alias("sources")
    ).select("corpus", "ordinal", "statement", "f.subject", "f.relation", "f.object", "sources")


def dense_corpora(facts: DataFrame, sources: DataFrame, corpus: str) -> DataFrame:
    """(corpus) of enough facts for a graph: 20, and two for each text."""
    n = sources.groupBy(F.col(corpus).alias("corpus")).agg(F.count(F.lit(1)).alias("texts"))
    return facts.groupBy("corpus").agg(F.count(F.lit(1)).alias("facts")).join(n, "corpus").where(F.col("facts") >= F.greatest(F.lit(20), 2 * F.col("texts"))).select("corpus")


def _rule_rows(law: str) -> list[tuple[str, str, str, float, int]]:
    """(kind, relation, pattern, weight, place) of all rules that a law reads; the weight of a cue is its length."""
    rows = [("cue", r, c, float(len(c)), 0) for r, cues in CUES.items() for c in cues]
    tables = {"closure": [("slot", SLOTS, 1.0, 0.08, 0.0)], "superposition": [("head", HEADS, 1.60, 0.05, 0.01), ("slot", SLOTS, 0.92, 0.04, 0.005)]}
    tables["absorbing"] = [*tables["superposition"], ("head", ABSORBING_HEADS, 1.72, 0.05, 0.01)]
    for kind, table, start, step, row_step in tables.get(law, []):
        rows += [(kind, r, pattern, start - step * j - row_step * i, i) for i, (relations, pattern) in enumerate(_rules(table)) for j, r in enumerate(relations)]
    return rows


def wanted_relations(queries: DataFrame, law: str) -> DataFrame:
    """(query_id, relation, w, k): weight of a relation as the end of a path (0 for none) and length of its longest cue.

    slingshot: the relations of the longest cue. closure: the first slot that fits, else half a weight for those.
    superposition: the greatest of heads, slots and cues. absorbing: further heads above those. ``queries`` has query_id
    and query; the rules are a literal array of some 250 entries, exploded beside each question.
    """
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("relation"), F.lit(p).alias("pattern"), F.lit(w).alias("weight"), F.lit(i).alias("place")) for k, r, p, w, i in _rule_rows(law)])
    hits = queries.select("query_id", F.lower("query").alias("low"), F.explode(rules).alias("x")).select("query_id", "low", "x.*")
    hits = hits.where(F.when(F.col("kind") == "cue", F.contains("low", F.col("pattern"))).otherwise(F.expr("low rlike pattern"))).drop("low")
    by = Window.partitionBy("query_id")
    cue, slot = F.col("kind") == "cue", F.col("kind") == "slot"
    longest, first = F.max(F.when(cue, F.col("weight"))).over(by), F.min(F.when(slot, F.col("place"))).over(by)
    if law == "slingshot":
        w = (cue & (F.col("weight") == longest)).cast("double")
    elif law == "closure":
        w = F.when(slot & (F.col("place") == first), F.col("weight")).when(cue & first.isNull() & (F.col("weight") == longest), 0.5).otherwise(0.0)
    else:
        w = F.when(cue, 0.56 + F.least(F.lit(0.24), F.col("weight") / 80.0)).otherwise(F.col("weight"))
    hits = hits.select("query_id", "relation", w.alias("w"), F.when(cue, F.col("weight")).otherwise(0.0).alias("k"))
    return hits.groupBy("query_id", "relation").agg(F.max("w").alias("w"), F.max("k").alias("k"))


@dataclass(frozen=True)
class Law:
    """How a search goes: hops, anchors of a question, gain at the end, and the terms of the later laws."""

    name: str
    hops: int
    anchors: int = 6
    end_gain: float = 8.0
    end_weight: float = 1.0
    cover_weight: float = 0.0
    unsupported: float = 0.20
    repeat_cost: float = 0.0
    acyclic: bool = False
    absorb: bool = False
    consensus: bool = False


SLINGSHOT = Law("slingshot", 3, end_gain=6.0, end_weight=0.0)
CLOSURE = Law("closure", 4)
SUPERPOSITION = Law("superposition", 5, 12, end_weight=1.35, cover_weight=1.10, unsupported=-0.18, consensus=True)
ABSORBING = Law("absorbing", 5, 12, end_weight=1.35, cover_weight=1.10, unsupported=-0.18, repeat_cost=1.25, acyclic=True, absorb=True, consensus=True)


def answer_questions(facts: DataFrame, queries: DataFrame, law: Law) -> DataFrame:
    """(corpus, query_id, answer, relation, ordinal, primary, dependency, path, score): the answer of each question.

    ``facts`` from statement_facts, ``queries`` with corpus, query_id, query and prefix: only texts placed before prefix
    are visible. Anchors are the subjects that the question names, the longest first. Each hop is one join of the best
    path per (question, entity, relations covered) with the visible edges. A question without anchors, wanted relations
    or path has no row. primary are the texts of the last edge, dependency those of the edges before it. Ties go to the
    shorter path (later laws: the longer), then to the later statement.
    """
    per = materialize(wanted_relations(queries, law.name), "wanted")
    ends_at = per.where("w > 0").groupBy("query_id").agg(F.array_sort(F.collect_set("relation")).alias("wanted"))
    q = materialize(queries.select("corpus", "query_id", word_form("query").alias("words"), "prefix").join(ends_at, "query_id"), "questions")
    seen = facts.join(q.select("corpus", "query_id", "prefix"), "corpus").withColumn("sources", F.filter("sources", lambda s: s < F.col("prefix"))).where(F.size("sources") > 0)
    equal = F.struct("ordinal", F.length(word_form("object")), F.size("sources"), "object") if law.consensus else F.struct("ordinal", -F.element_at("sources", 1), "object")
    latest = seen.groupBy("query_id", word_form("subject").alias("s"), "relation").agg(F.max_by(F.struct("subject", "object", "ordinal", "sources"), equal).alias("f"))
    edges = latest.join(per, ["query_id", "relation"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("w", "k")})
    k = F.greatest(F.col("k"), 5.0 * F.col("w")) if law.consensus else F.col("k")
    energy = F.when(k > 0, 0.20 + F.least(F.lit(3.0), k / 5.0)).otherwise(F.lit(law.unsupported))
    edges = materialize(edges.select("query_id", "s", "relation", "f", "w", energy.alias("energy"), word_form("f.object").alias("o")), "statement_edges")
    subjects = facts.select("corpus", word_form("subject").alias("s")).distinct()
    named = q.select("corpus", "query_id", "words", "wanted").join(subjects, "corpus").where(F.contains("words", F.col("s")))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("s").desc(), "s"))
    front = named.withColumn("n", top).where(F.col("n") <= law.anchors).select("query_id", "wanted", F.col("s").alias("entity"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("covered"), F.array().cast("array<struct<subject:string,relation:string,object:string,sources:array<bigint>>>").alias("path"), F.array(F.col("s")).alias("met"))
    ends = None
    for hop in range(1, law.hops + 1):
        e = edges.withColumnRenamed("query_id", "qid")
        step = front.join(e, (F.col("query_id") == F.col("qid")) & (F.col("entity") == F.col("s")))
        if law.acyclic and hop > 1:
            step = step.where(~F.array_contains("met", F.col("o")))
        again = F.size(F.filter("path", lambda x: x["relation"] == F.col("relation")))
        step = step.withColumns({
            "score": F.col("score") + F.col("energy") - law.repeat_cost * again,
            "path": F.concat("path", F.array(F.struct(F.col("f.subject").alias("subject"), F.col("relation").alias("relation"), F.col("f.object").alias("object"), F.col("f.sources").cast("array<bigint>").alias("sources")))),
            "covered": F.when(F.col("w") > 0, F.array_sort(F.array_union("covered", F.array("relation")))).otherwise(F.col("covered")), "met": F.array_union("met", F.array("s", "o")),
        })
        step = materialize(step.select("query_id", "wanted", "relation", "w", "f", F.col("o").alias("entity"), "score", "path", "covered", "met"), "statement_step")
        cover = F.size("covered") / F.size("wanted")
        total = F.col("score") + law.end_gain + law.end_weight * F.col("w") + law.cover_weight * cover
        done = step.where("w > 0").select("query_id", total.alias("total"), F.lit(hop if law.consensus else -hop).alias("length"), "f", "relation", "path")
        ends = done if ends is None else ends.unionByName(done)
        if hop < law.hops:
            go = step.where(~((F.col("w") > 0) & (F.size("covered") == F.size("wanted")))) if law.absorb else step
            key = ["query_id", "entity", "covered"] if law.consensus else ["query_id", "entity"]
            rest = ["score", "path", "met", "wanted"] if law.consensus else ["score", "path", "met", "wanted", "covered"]
            best = go.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("score", F.to_json("path"))).alias("b"))
            front = best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])
    ends = ends.withColumn("a", word_form("f.object"))
    rank = F.struct("total", "length", F.col("f.ordinal"))
    one = ends.groupBy("query_id", "a").agg(F.max_by(F.struct("total", "length", "f", "relation", "path"), rank).alias("b"), F.count(F.lit(1)).alias("n")).select("query_id", "b.*", "n")
    if law.consensus:
        one = one.withColumn("total", F.col("total") + F.least(F.lit(0.45), 0.08 * (F.col("n") - 1)))
    best = one.groupBy("query_id").agg(F.max_by(F.struct("total", "f", "relation", "path"), rank).alias("b")).select("query_id", "b.*")
    primary = F.col("f.sources").cast("array<bigint>")
    before = F.array_except(F.array_distinct(F.flatten(F.transform("path", lambda x: x["sources"]))), primary)
    out = best.select("query_id", F.col("f.object").alias("answer"), F.col("f.subject").alias("subject"), "relation", F.col("f.ordinal").alias("ordinal"), primary.alias("primary"), before.alias("dependency"), F.transform("path", lambda x: F.concat_ws(" | ", x["subject"], x["relation"], x["object"])).alias("path"), F.round("total", 6).alias("score"))
    return q.select("corpus", "query_id").join(out, "query_id")


def answer_echoes(answers: DataFrame, sources: DataFrame, queries: DataFrame, ord_col: str, text: str, corpus: str) -> DataFrame:
    """(query_id, ord): visible texts that contain the answer."""
    a = answers.join(queries.select("query_id", "prefix"), "query_id").select("corpus", "query_id", "prefix", word_form("answer").alias("a")).where("a <> ''")
    t = sources.where(F.col(text).isNotNull()).select(F.col(corpus).alias("corpus"), F.col(ord_col).alias("ord"), word_form(text).alias("words"))
    return a.join(t, "corpus").where((F.col("ord") < F.col("prefix")) & F.contains("words", F.col("a"))).select("query_id", "ord")


def superseded_answers(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, object, ordinal, sources): other versions of the edge that gave the answer, for audit."""
    f = facts.select("corpus", word_form("subject").alias("s"), F.col("relation").alias("r"), "object", F.col("ordinal").alias("o"), "sources")
    j = answers.select("corpus", "query_id", word_form("subject").alias("s"), F.col("relation").alias("r"), "answer", "ordinal").join(f, ["corpus", "s", "r"])
    return j.where((F.col("o") != F.col("ordinal")) | (word_form("object") != word_form("answer"))).select("query_id", "object", F.col("o").alias("ordinal"), "sources")


def common_overlaps(texts: DataFrame, part: str, order: str, text: str, most: int = 512, least: int = 32) -> DataFrame:
    """(part, order, overlap): the longest end of a text, least to most characters, that begins the next one; 0 for none."""
    pair = texts.select(part, order, F.col(text).alias("l"), F.lead(text).over(Window.partitionBy(part).orderBy(order)).alias("r")).where("r is not null")
    width = F.least(F.length("l"), F.length("r"), F.lit(most))
    hit = F.filter(F.sequence(width, F.lit(least), F.lit(-1)), lambda w: F.right(F.col("l"), w) == F.left(F.col("r"), w))
    return pair.select(part, order, F.when(width < least, F.lit(0)).otherwise(F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0))).alias("overlap"))


def rebuilt_documents(texts: DataFrame, part: str, order: str, text: str) -> DataFrame:
    """(part, document, start, end, windows): documents marked ``Document n:`` in overlapping windows, with the windows that show them.

    A part counts if most of its windows overlap by one same length and it holds 20 documents. The stream is never put
    together: marks are found inside windows (with the head of the next one, so that none is cut) at their place in the
    stream, a mark seen twice counts once.
    """
    o = common_overlaps(texts, part, order, text)
    n = o.groupBy(part, "overlap").agg(F.count(F.lit(1)).alias("n"))
    usual = n.where("overlap > 0").groupBy(part).agg(F.max(F.struct("n", "overlap")).alias("u"))
    whole = n.groupBy(part).agg(F.sum("n").alias("all"))
    usual = usual.join(whole, part).where("u.n >= 0.75 * all").select(part, F.col("u.overlap").alias("overlap"))
    w = Window.partitionBy(part).orderBy(order)
    t = texts.join(usual, part).withColumn("len", F.length(text)).withColumn("start", F.coalesce(F.sum(F.col("len") - F.col("overlap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = materialize(t.select(part, order, text, "start", (F.col("start") + F.col("len")).alias("end")), "windows")
    mark = r"(?i)(?<!\w)Document\s+\d+\s*:"
    pieces = F.split(text, f"(?={mark})")
    at = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.struct(F.aggregate(F.slice(pieces, F.lit(1), i - 1), F.lit(0), lambda a, x: a + F.length(x)).alias("p"), F.element_at(pieces, i).alias("x")))
    marks = t.select(part, "start", F.inline(at)).where(F.rlike("x", F.lit(f"^{mark}"))).select(part, (F.col("start") + F.col("p")).alias("d")).distinct()
    by = Window.partitionBy(part).orderBy("d")
    docs = marks.select(part, F.col("d").alias("d_start"), F.coalesce(F.lead("d").over(by), F.lit(2**60)).alias("d_end"), F.row_number().over(by).alias("document"), F.count(F.lit(1)).over(Window.partitionBy(part)).alias("many")).where("many >= 20")
    both = docs.join(t.select(part, order, "start", "end"), part).where((F.col("start") < F.col("d_end")) & (F.col("end") > F.col("d_start")))
    return both.groupBy(part, "document").agg(F.min("d_start").alias("start"), F.max("d_end").alias("end"), F.array_sort(F.collect_list(order)).alias("windows"))
