"""Laws of relevance as column expressions: planetary and cognitive force, capsules, gravity, directives, tethers, ghosts.

Every law takes its fields as columns in [0, 1] (a missing or null field counts 0), so it is one projection over pairs of
question and row; what is chosen from the scores is in palimpsest.operators.selection and capsules.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import modes as M
from palimpsest.functions import text as T
from palimpsest.functions.patterns import pattern, says
from palimpsest.operators.lifecycle import age_days, numbers_of

Arrays = dict[str, np.ndarray]
# Shares of the fields of each law.
COGNITIVE = {"semantic": 0.30, "lexical": 0.18, "role": 0.24, "episode": 0.12, "recency": 0.08, "trust": 0.08}
CAPSULE = {"semantic": 0.26, "lexical": 0.18, "entity": 0.14, "temporal": 0.12, "contradiction": 0.10, "directive": 0.10, "trust": 0.10}
GRAVITY = {"semantic": 0.30, "lexical": 0.14, "entity": 0.15, "temporal": 0.08, "relation": 0.12, "trust": 0.08, "vitality": 0.05, "mass": 0.03, "novelty": 0.05}
HOME_INERTIA, MIGRATION_COST, UNCERTAINTY_COST, CAPTURE_TEMPERATURE = 0.10, 0.035, 0.07, 0.16
EVENT = {"force": 0.46, "semantic": 0.30, "lexical": 0.14}
FOCUS = {"force": 0.31, "semantic": 0.23, "lexical": 0.13, "atom": 0.21, "rare": 0.12}
TETHER = {"force": 0.34, "semantic": 0.30, "lexical": 0.17, "entity": 0.11, "temporal": 0.08}
PERIAPSIS = {"nucleus_semantic": 0.50, "nucleus_lexical": 0.30, "semantic": 0.12, "lexical": 0.08}
BROAD_COVER = {"force": 0.44, "semantic": 0.36, "lexical": 0.20}
# Words of a question that fit a family of directives, and words of no content in directives.
FAMILY_CUES = {
    "format": ["code", "snippet", "implement", "syntax", "format", "代码", "实现", "格式"], "dependencies": ["library", "libraries", "dependency", "framework", "tool", "库", "依赖", "框架", "工具"],
    "response_style": ["answer", "reply", "response", "explain", "回答", "回复", "解释"], "language": ["language", "english", "chinese", "语言", "英文", "中文"],
    "privacy": ["security", "private", "privacy", "secret", "安全", "隐私", "秘密"], "workflow": ["how", "implement", "build", "create", "setup", "如何", "实现", "创建", "设置"],
}
DIRECTIVE_STOP = "the a an and or to of in on for with my your our this that is are was were be project user assistant".split()
LOOKUP = "did {i you we}, when did, where did, what .. {mention mentioned}, how {much long} did, said i, was recommended"
MANY_SOURCES = "across, between, considering, combined, in total, how many {different total}, evolved, influence, influenced, from .. to"
USUAL = "prefer, preference, preferred, my usual"
# Modes of a question for distilled traces.
GHOST_MODES = {
    "preference": "recommend, suggest, tip, tips, advice, what should, what to, which one, do you think, any ideas, helpful",
    "temporal": "ago, before, after, between, first, last, earliest, latest, recently, day, days, week, weeks, month, months, year, years, when, order, since, until, most recently, monday, tuesday, wednesday, thursday, friday, saturday, sunday",
    "evolution": "current, currently, previous, previously, initially, originally, used to, switch, switched, change, changed, new, newest, latest, now, before getting, after {the my her his}, still, anymore",
}
NUMBER_WORDS = "two three four five six seven eight nine ten".split()
# Where a question falls apart.
SPLITS = {"capsule": r"(?i)\s*(?:,|;|\band\b|\bthen\b|\bincluding\b|\bas well as\b|以及|并且|然后|包括|、)\s*", "gravity": r"(?i)\s*(?:,|;|、|，|；|\band\b|\bthen\b|\bwhile\b|\bas well as\b|以及|并且|然后|同时|还有)\s*", "clause": r"(?i)\s*(?:;|\?|\.(?=\s+[A-Z])|\b(?:and|but|while|whereas)\b)\s*"}
CLAUSE_STOP = "what where when which who whose how why did does do was were is are have has had my i me the a an of to in on at for from with about that this".split()
CLAUSE_VERBS = "did, does, do, was, were, is, are, have, has, had, went, go, got, bought, made, created, changed, started, finished, attended, worked, lived, used, prefer, liked, wanted, planned, graduated, spent, took, take"
# Questions told as statements, the first that fits; {1} and {2} are what stands in the gaps.
DECLARED = [
    ("what .. did i ..", "I {2} {1}"), ("where did i ..", "I {1} at a place"), ("when did i ..", "I {1} on a date"), ("how much did i ..", "I {1} an amount"), ("how long did it take me to ..", "I {1} for a duration"),
    ("how long did i ..", "I {1} for a duration"), ("how many .. did i ..", "I {2} a number of {1}"), ("what was my ..", "My {1} was"), ("what is the name of ..", "The name of {1} is"), ("who did i ..", "I {1} a person"),
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weigh(shares: dict[str, float], fields: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(fields.get(k, F.lit(0.0)), F.lit(0.0)) for k, w in shares.items()])


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def temporal_phase(valid_from: Column, valid_to: Column, updated: Column, now: Column, about_time: Column) -> Column:
    """How well a row's time fits: rows to come or over count little, but for questions about time; else by age."""
    age = F.exp(-age_days(now, updated) / F.when(about_time, 365.0).otherwise(120.0))
    return F.when(valid_from > now, F.when(about_time, 0.75).otherwise(0.15)).when(valid_to <= now, F.when(about_time, 0.70).otherwise(0.05)).otherwise(F.coalesce(age, F.lit(0.0)))


def negated(text: str) -> Column:
    plain = F.array_join(T.memory_tokens(text), " ")
    return T._once(plain, lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(n)) for n in (*T.NEGATIONS, "从未")]))


def contradiction(query: str, text: str) -> Column:
    """0.65 where just one of the texts is negated, 0.55 where their numbers have nothing in common; 1 at most."""
    a, b = numbers_of(query), numbers_of(text)
    apart = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    return F.least(F.lit(1.0), 0.65 * (negated(query) != negated(text)).cast("double") + 0.55 * apart.cast("double"))


def planetary_force(weights: dict[str, Column], fields: dict[str, Column], against: Column, stable: Column, repulsion: float = 0.20) -> Column:
    """Attraction by the question's weights less repulsion, 0 at least; rows that are not stable keep 0.78 of it."""
    pull = reduce(lambda a, b: a + b, [w * F.coalesce(fields.get(k, F.lit(0.0)), F.lit(0.0)) for k, w in weights.items()])
    return F.greatest(F.lit(0.0), F.when(stable, 1.0).otherwise(0.78) * (pull - repulsion * against))


def planetary_pairs(shared: Arrays, q: Arrays, m: Arrays) -> np.ndarray:
    """Planetary force over arrays of pairs (see operators.pairing), in the same order of operations as planetary_force."""
    near = pair_fields(shared, q, m)
    age = np.where(q["about_time"], m["slow_age"], m["fast_age"])
    pull = q["w_semantic"] * near["semantic"] + q["w_bm25"] * near["lexical"] + q["w_entity"] * (shared["items"] / np.maximum(1, q["n_items"])) + q["w_temporal"] * age
    pull = pull + q["w_authority"] * m["trust"] + q["w_utility"] * m["utility"]
    apart = (q["n_numbers"] > 0) & (m["n_numbers"] > 0) & (shared["numbers"] == 0)
    against = np.minimum(1.0, 0.65 * (q["negated"] != m["negated"]) + 0.55 * apart)
    return np.maximum(0.0, np.where(m["stable"], 1.0, 0.78) * (pull - 0.20 * against))


def orbit_of(force: Column, mass: Column) -> dict[str, Column]:
    return {"radius": 1.0 / (0.05 + force), "energy": 0.0 - mass * force}


def cognitive_force(fields: dict[str, Column], age: Column) -> Column:
    """Force with directive and episode resonance; directives age slower. In [0, 1.25]."""
    recency = F.exp(-age / F.when(F.coalesce(fields.get("role", F.lit(0.0)), F.lit(0.0)) > 0, 365.0).otherwise(150.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.25), weigh(COGNITIVE, fields | {"recency": recency})))


def cognitive_pairs(shared: Arrays, q: Arrays, m: Arrays) -> np.ndarray:
    """Cognitive force over arrays of pairs (see operators.pairing), in the same order of operations as cognitive_force."""
    near = pair_fields(shared, q, m)
    w = COGNITIVE
    force = w["semantic"] * near["semantic"] + w["lexical"] * near["lexical"] + w["role"] * m["role"] + w["recency"] * m["recency"] + w["trust"] * m["trust"]
    return np.maximum(0.0, np.fmin(1.25, force))  # NaN is above all numbers, as in SQL


def pair_fields(shared: Arrays, q: Arrays, m: Arrays) -> Arrays:
    """Overlaps of the words of pairs that share one or more."""
    n = shared["words"]
    return {"semantic": n / (q["n_words"] + m["n_words"] - n), "lexical": n / np.maximum(1, q["n_words"])}


def capsule_relevance(fields: dict[str, Column]) -> Column:
    return weigh(CAPSULE, fields)


def capsule_time(episodic: Column, months: Column, age: Column) -> Column:
    """Temporal field of a capsule: by the months it spans for episodic questions, else by its youngest member."""
    return F.when(episodic, F.least(F.lit(1.0), 0.45 + 0.20 * months)).otherwise(F.exp(-age / 365.0))


def goal_score(semantic: Column, lexical: Column) -> Column:
    return 0.72 * semantic + 0.28 * lexical


def covered_goals(scores: Column) -> Column:
    """Positions of the goals that a capsule covers: 0.24 at least, and 0.68 of its best."""
    least = F.greatest(F.lit(0.24), 0.68 * F.array_max(scores))
    return F.filter(F.transform(scores, lambda s, i: F.when(s >= least, i)), lambda i: i.isNotNull())


def gravity(fields: dict[str, Column], home: Column, migrates: Column) -> dict[str, Column]:
    """Attraction of a row for a goal, its net potential away from home, and the probability of capture."""
    trust = _unit(F.coalesce(fields.get("trust", F.lit(0.0)), F.lit(0.0)))
    pull = weigh(GRAVITY, fields | {"trust": trust})
    net = pull - HOME_INERTIA * home - MIGRATION_COST * migrates - UNCERTAINTY_COST * (1.0 - trust)
    x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), net / CAPTURE_TEMPERATURE))
    return {"attraction": pull, "net": net, "capture": 1.0 / (1.0 + F.exp(-x))}


def vitality(utility: Column, confidence: Column) -> Column:
    return _unit(0.6 * utility + 0.4 * confidence)


def bounded_mass(mass: Column) -> Column:
    return F.tanh(F.log1p(F.greatest(F.lit(0.0), mass)) / 3.0)


def rarity(frequencies: Column) -> Column:
    """Mean rarity of a row's entities from the array of their frequencies; 0 without any."""
    total = F.aggregate(frequencies, F.lit(0.0), lambda a, n: a + 1.0 / F.log2(2.0 + n))
    return F.when(F.size(frequencies) > 0, total / F.size(frequencies)).otherwise(0.0)


def tidal_link(left: Column, right: Column, relation: Column, semantic: Column) -> Column:
    """Link of two rows by shared entities (maps of entity to rarity) or relations; likeness alone makes none."""
    mass = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
    shared = F.aggregate(F.array_intersect(F.map_keys(left), F.map_keys(right)), F.lit(0.0), lambda a, k: a + F.least(F.element_at(left, k), F.element_at(right, k)))
    entity = shared / F.greatest(F.lit(1e-9), F.least(mass(left), mass(right))) * F.least(F.lit(1.0), shared)
    bond = F.greatest(entity, relation)
    return F.least(F.lit(1.0), 0.82 * bond + 0.18 * semantic * bond)


def event_score(fields: dict[str, Column], rank: Column, new_group: Column) -> Column:
    return weigh(EVENT, fields) + 0.06 / (1.0 + rank) + 0.04 * new_group.cast("double")


def _content(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_.:/-]+|[㐀-鿿]+"), F.lit(0)), lambda w: F.lower(w)), lambda w: ~w.isin(DIRECTIVE_STOP)))


def directive_gravity(query: Column, text: Column, role: Column, family: Column) -> Column:
    """Bonus of a directive for a question: 0.24 and up to 0.14 by how well it applies, else 0.

    Questions that look something up or need many sources take none; instructions need a task, preferences a question
    about what is preferred. It applies by shared words or by a word of its family in the question.
    """
    modes = M.query_modes(query)
    low = F.lower(query)
    match = reduce(lambda a, kv: a.when(family == kv[0], F.rlike(low, F.lit("|".join(kv[1])))), FAMILY_CUES.items(), F.when(F.lit(False), F.lit(False))).otherwise(False)
    q = _content(query)
    lexical = F.size(F.array_intersect(q, _content(text))) / F.greatest(F.lit(1), F.size(q))
    applies = F.least(F.lit(1.0), F.greatest(F.when(role == "instruction", 0.45).otherwise(0.30), 0.58 * lexical + 0.42 * match.cast("double")))
    fits = ((role == "instruction") & modes["instructions"]) | ((role == "preference") & modes["preferences"] & says(query, USUAL))
    ok = fits & ~says(query, LOOKUP) & ~says(query, MANY_SOURCES) & (match | (lexical >= 0.15))
    return F.when(F.coalesce(ok, F.lit(False)), 0.24 + 0.14 * applies).otherwise(0.0)


def atom_overlap(tokens: Column, entities: Column, numbers: Column, query_tokens: Column, query_entities: Column, query_numbers: Column) -> Column:
    share = lambda a, q: F.size(F.array_intersect(a, q)) / F.greatest(F.lit(1), F.size(q))
    return 0.62 * share(tokens, query_tokens) + 0.25 * share(entities, query_entities) + 0.13 * share(numbers, query_numbers)


def rare_mass(candidates: Column, frequency: Column) -> Column:
    """Pull of a question's term that few of the candidates hold."""
    return F.log(1.0 + (candidates + 0.5) / (frequency + 0.5))


def capsule_tethers(capsules: DataFrame, query_id: str, rank: str, members: str, coverage: str, limit: int = 10, most: int = 2) -> DataFrame:
    """(query, sources): sources that are tied to a question's first capsule, of capsules that score above it.

    ``members`` are structs (source, value) with the tether value of each source, ``coverage`` the share of the
    question's terms a capsule holds. A capsule scores 0.48 of its best value, 0.27 of the mean of its best two, 0.19 of
    its coverage and 0.06 of its reciprocal rank; the best source of each winner is tied, at most ``most``.
    """
    v = F.reverse(F.array_sort(F.transform(members, lambda m: m["value"])))
    peak, two = F.element_at(v, 1), F.slice(v, 1, 2)
    density = F.aggregate(two, F.lit(0.0), lambda a, x: a + x) / F.size(two)
    rows = capsules.where((F.col(rank) <= limit) & (F.size(members) > 0))
    rows = rows.withColumn("_s", 0.48 * peak + 0.27 * density + 0.19 * F.col(coverage) + 0.06 / F.col(rank))
    first = rows.where(F.col(rank) == 1).select(query_id, F.col("_s").alias("_f"))
    best = F.element_at(F.array_sort(F.transform(members, lambda m: F.struct((-m["value"]).alias("v"), m["source"].alias("s")))), 1)["s"]
    won = rows.where(F.col(rank) > 1).join(first, query_id).where("_s > _f").withColumn("_n", F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("_s").desc(), rank)))
    won = won.where(F.col("_n") <= most).select(query_id, "_n", best.alias("source"))
    return won.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "source"))), lambda x: x["source"]).alias("sources"))


def periapsis(fields: dict[str, Column]) -> Column:
    return weigh(PERIAPSIS, fields)


def may_promote(top: Column, second: Column, contact: Column, current_contact: Column, marked: Column, ratio: float = 1.08, margin: float = 0.055) -> Column:
    """Whether the best source replaces the first one: clearly ahead of the next, and in contact with the question."""
    return marked & (top / F.greatest(F.lit(1e-9), second) >= ratio) & (top - second >= margin) & (contact >= 0.55 * current_contact)


def ghost_weights(modes: Column) -> dict[str, Column]:
    """Weight of distilled traces for promotion and for navigation, by the modes of a question."""
    has = lambda *m: reduce(lambda a, b: a | b, [F.array_contains(modes, F.lit(x)) for x in m])
    promote = F.when(has("temporal", "evolution"), 0.36).when(has("composite", "resonance"), 0.34).otherwise(0.30)
    return {"promote": promote, "navigate": F.when(has("temporal"), 0.65).when(has("evolution", "composite", "resonance"), 0.55).otherwise(promote)}


def ghost_score(base: Column, lexical: Column, fact_mass: Column, weight: Column) -> Column:
    """Score of a distilled trace; -1 for a silent one, which never enters."""
    return F.when(fact_mass > 0, (1.0 - weight) * base + weight * (0.82 * lexical + 0.18 * fact_mass)).otherwise(-1.0)


def ghost_modes(query: Column) -> Column:
    return F.filter(F.array(*[F.when(says(query, w), F.lit(k)) for k, w in GHOST_MODES.items()]), lambda m: m.isNotNull())


def ghost_budget(query: Column, modes: Column) -> Column:
    """Sources a question may need: 12 if it names a number from two to ten, else by its modes."""
    has = lambda *m: reduce(lambda a, b: a | b, [F.array_contains(modes, F.lit(x)) for x in m])
    number = F.rlike(F.lower(query), F.lit(pattern(", ".join(NUMBER_WORDS)) + r"|\b(?:[2-9]|10)\b"))
    return F.when(number, 12).when(has("evolution"), 5).when(has("composite", "resonance"), 6).when(has("temporal"), 10).otherwise(2)


def _parts(query: Column, how: str, least: int) -> Column:
    return F.filter(F.transform(F.split(query, SPLITS[how]), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def capsule_goals(query: Column, most: int = 6) -> Column:
    """The question and its parts of four characters or more."""
    return F.slice(F.array_distinct(F.concat(F.array(F.trim(query)), _parts(query, "capsule", 4))), 1, most)


def gravity_goals(query: Column, most: int = 6) -> Column:
    """The parts of a question of three characters or more; the whole where there is but one."""
    p = F.array_distinct(_parts(query, "gravity", 3))
    return F.when(F.size(_parts(query, "gravity", 3)) <= 1, F.array(F.trim(query))).otherwise(F.slice(p, 1, most))


def _cleaned(query: Column) -> Column:
    flat = F.regexp_replace(F.trim(query), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"(?i)^(?:please\s+)?(?:can|could|would|will)\s+you\s+(?:tell|remind|show)\s+me\s+", ""), r"^[ .?]+|[ .?]+$", "")


def clauses(query: Column, most: int = 4) -> Column:
    """The whole question, then its clauses with two words of content and a verb, if there are two such clauses."""
    whole = _cleaned(query)
    words = lambda p: F.size(F.filter(T.retrieval_terms(p), lambda t: (F.length(t) > 2) & ~t.isin(CLAUSE_STOP)))
    pieces = F.transform(F.split(whole, SPLITS["clause"]), lambda p: F.regexp_replace(p, "^[ ,.]+|[ ,.]+$", ""))
    good = F.filter(pieces, lambda p: (words(p) >= 2) & F.rlike(F.lower(p), F.lit(pattern(CLAUSE_VERBS))))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(good) < 2, F.array(whole)).otherwise(F.array_distinct(F.concat(F.array(whole), F.slice(good, 1, most))))


def statements_of(query: Column) -> Column:
    """The question, and as a statement in the first person where one of the forms fits."""
    whole, told = _cleaned(query), F.when(F.lit(False), "")
    for form, out in DECLARED:
        gaps = ["(.+?)"] * (form.count("..") - 1) + ["(.+)"]
        p = "(?i)^" + form.replace("..", "{}").format(*gaps) + "$"
        told = told.when(F.rlike(whole, F.lit(p)), F.regexp_replace(whole, p, out.replace("{1}", "$1").replace("{2}", "$2")))
    return F.array_distinct(F.filter(F.array(whole, told), lambda x: x.isNotNull() & (x != "")))


def ambiguous_references(df: DataFrame, part: str, order: list[str], text: str, subjects: str, back: int = 24) -> DataFrame:
    """Rows that begin with a pronoun after two different subjects or more in the ``back`` rows before them.

    ``subjects`` is the array of names of a row. The window keeps at most ``back`` arrays.
    """
    pronoun = F.rlike(F.lower(F.col(text)), F.lit(r"^\s*(?:she|he|they|it|her|him|them)\b|^\s*(?:她|他|他们|她们|它)"))
    seen = F.flatten(F.collect_list(subjects).over(Window.partitionBy(part).orderBy(*order).rowsBetween(-back, -1)))
    return df.withColumn("_seen", seen).where(pronoun & (F.size(F.array_distinct("_seen")) >= 2)).drop("_seen")
