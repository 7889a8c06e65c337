"""Variant spellings of names, linked by noisy-channel attribution.

Within a tenant's scope spellings are ranked as candidate canonical forms by how often they are written and by how
seldom a canonical form is abbreviated. A spelling is attached to the candidate of maximum posterior: the prior of the
candidate times the likelihood that it was typed as the spelling (typos, initials, short forms, reordered parts, dropped
parts, acronyms), unless an entity of its own is likelier. The likelihoods of the channel are estimated from the
linked spellings by expectation maximization. Candidates come from shared keys (deletion neighbourhoods of the rare
name part with a letter of the other part, acronym letters), never from all pairs of a scope.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canonical import canonical_text
from palimpsest.llm.lexicon import HAN_COMPOUND, LEGAL_FORMS, ORG_WORDS, ROLE_LEADS, ROLE_WORDS, TITLES, nickname_table
from palimpsest.session import materialize

# Operations of the channel with their first probabilities; expectation maximization estimates them on the data, but for
# the last two, which tell entities apart: a known given name for another, and one legal form for another.
OPS = {
    "typo": 0.03, "two typos": 0.0002, "initial": 0.1, "initial of a form": 0.03, "nickname": 0.1, "no given name": 0.02, "no middle name": 0.4, "reorder": 0.1, "acronym": 0.05,
    "cut word": 0.1, "no legal form": 0.5, "other legal form": 0.06, "other given name": 3e-7,
}
_FIXED = ("other legal form", "other given name")
# A sum of operations is one integer with four bits for each: how often each was used.
TYPO, TYPO2, INITIAL, INITIAL2, NICKNAME, NO_GIVEN, NO_MIDDLE, REORDER, ACRONYM, CUT_WORD, NO_LEGAL, OTHER_LEGAL, OTHER_GIVEN = (1 << 4 * i for i in range(len(OPS)))
IMPOSSIBLE = -1
# Log probability of an entity of its own though a candidate is near, and the gain of two spellings given for one mention.
NEW_ENTITY, LISTED_TOGETHER = -14.0, 6.0
FIRST = tuple(math.log(p) for p in OPS.values())
NICKS = nickname_table()


@lru_cache(10_000)
def log_likelihood(ops: int, logs: tuple[float, ...] = FIRST) -> float:
    return -1e9 if ops < 0 else sum((ops >> 4 * i & 15) * v for i, v in enumerate(logs))


def _best(*options: int) -> int:
    return max(options, key=log_likelihood)


def _plus(*ops: int) -> int:
    return IMPOSSIBLE if min(ops) < 0 else sum(ops)


@dataclass(frozen=True)
class NameForm:
    """A spelling taken apart: parts in natural order; kind 'person', 'org', 'acronym' or '' (no name)."""

    kind: str
    parts: tuple[str, ...]
    middle: str = ""
    legal: str = ""
    titled: bool = False
    unsure: bool = False  # the order of given and family name is open
    cut: tuple[bool, ...] = ()


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@lru_cache(200_000)
def parse_name(name: str) -> NameForm:
    """Take a spelling apart; roles, product names that end in a number and empty strings give kind ''."""
    text = " ".join((canonical_text(name) or "").split())
    low = fold(text).replace("’", "'")
    han = low.replace(" ", "").replace("·", "")
    if len(han) >= 2 and all("一" <= c <= "鿿" for c in han):
        cut = 2 if han[:2] in HAN_COMPOUND and len(han) > 2 else 1
        return NameForm("person", (han[cut:], han[:cut])) if len(han) <= 4 else NameForm("org", (han,))
    words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", low)
    if not words or re.search(r"\d", low) or "@" in low:
        return NameForm("", ())
    if all(w in ROLE_WORDS or w in ROLE_LEADS for w in words):
        return NameForm("", ())
    dotted = re.fullmatch(r"(?:[^\W\d_]\.\s?){2,5}", low)
    if dotted:
        return NameForm("acronym", ("".join(words),))
    low = re.sub(r"\b((?:[^\W\d_]\.){2,})(?=\W|$)", lambda m: m.group().replace(".", ""), low)  # g.m.b.h. -> gmbh
    head, comma, tail = low.partition(",")
    tok = lambda s: re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*\.?", s)
    first, second = tok(head), tok(tail)
    legal = ""
    if second and all(t.rstrip(".") in LEGAL_FORMS for t in second):
        legal, second, comma = second[0].rstrip("."), [], ""
    tokens = second + first if comma and second else first
    titled = False
    while tokens and tokens[0].rstrip(".") in TITLES and len(tokens) > 1:
        tokens, titled = tokens[1:], True
    the = len(tokens) > 1 and tokens[0] == "the"
    if the:
        tokens = tokens[1:]
    while len(tokens) > 1 and tokens[-1].rstrip(".") in LEGAL_FORMS:
        legal, tokens = tokens[-1].rstrip("."), tokens[:-1]
    bare = [t.rstrip(".") for t in tokens]
    if len(bare) == 1 and not titled:
        letters = re.sub(r"\W", "", text.split()[0 if not the else 1].rstrip(",."))
        if 2 <= len(bare[0]) <= 5 and (letters.isupper() or legal):
            return NameForm("acronym", (bare[0],), legal=_legal(legal))
    long_parts = [t for t in bare if len(t) > 1]
    if not titled and (legal or the or len(long_parts) >= 3 or len(bare) == 2 and bare[1] in ORG_WORDS) and len(long_parts) == len(bare):
        return NameForm("org", tuple(bare), legal=_legal(legal), unsure=bool(comma and second), cut=tuple(t.endswith(".") for t in tokens))
    middle = ""
    if len(bare) >= 3:
        inner = [t for t in bare[1:-1] if len(t) == 1] or ([bare[-1]] if comma and len(bare[-1]) == 1 else [])
        # in 'Family, Given M.' the middle initial comes before the family name after the parts are put in order
        middle = inner[0] if inner else ""
        if middle:
            bare = [t for i, t in enumerate(bare) if not (len(t) == 1 and t == middle and 0 < i)]
    given, family = (bare[0], bare[-1]) if len(bare) > 1 else ("", bare[0])
    return NameForm("person", (given, family), middle, titled=titled, unsure=not comma and len(bare) == 2 and len(given) > 1)


def _legal(form: str) -> str:
    return {"limited": "ltd", "corporation": "corp", "incorporated": "inc", "company": "co"}.get(form, form)


@lru_cache(500_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance (adjacent swaps count one), or most + 1 if it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return min(last[-1], most + 1)


def _typed(a: str, b: str) -> int:
    """Operations by which one name part was typed as the other."""
    if a == b:
        return 0
    shorter = min(len(a), len(b))
    if shorter < 3:
        return IMPOSSIBLE
    d = edits(a, b)
    if d == 1 and (shorter >= 4 or len(a) != len(b) and max(len(a), len(b)) >= 4):
        return TYPO
    return TYPO2 if d == 2 and shorter >= 6 else IMPOSSIBLE


@lru_cache(200_000)
def _given(v: str, c: str) -> int:
    if v == c:
        return 0
    if not v or not c:
        return NO_GIVEN
    if len(v) == 1 or len(c) == 1:
        if len(v) == len(c):
            return IMPOSSIBLE
        i, full = (v, c) if len(v) == 1 else (c, v)
        if full[0] == i:
            return INITIAL
        return INITIAL2 if any(f[0] == i for f in NICKS.get(full, ())) else IMPOSSIBLE
    mine, other = NICKS.get(v, frozenset()), NICKS.get(c, frozenset())
    if mine & other:
        return NICKNAME
    straight = _typed(v, c)
    if v in NICKS and c in NICKS:  # two different known names are typos of each other only where counts speak for it
        return OTHER_GIVEN if straight == TYPO else IMPOSSIBLE
    slip, clean = (v, other) if c in NICKS else (c, mine)
    through = [TYPO + NICKNAME for full in clean for form in (full, *_forms(full)) if len(form) >= 4 and edits(slip, form, 1) == 1]
    return _best(straight, *through)


@lru_cache(2000)
def _forms(full: str) -> tuple[str, ...]:
    return tuple(k for k, v in NICKS.items() if full in v)


def _person(v: NameForm, c: NameForm) -> int:
    best = IMPOSSIBLE
    for pv, cost in ((v.parts, 0), (v.parts[::-1], REORDER)) if v.unsure else ((v.parts, 0),):
        for pc, more in ((c.parts, 0), (c.parts[::-1], REORDER)) if c.unsure else ((c.parts, 0),):
            # the same way around on both sides needs no second look
            if cost and more:
                continue
            best = _best(best, _plus(cost, more, _given(pv[0], pc[0]), _typed(pv[1], pc[1])))
    if v.middle and c.middle:
        return best if v.middle == c.middle else IMPOSSIBLE
    return _plus(best, NO_MIDDLE) if v.middle or c.middle else best


def _org(v: NameForm, c: NameForm) -> int:
    legal = 0 if v.legal == c.legal else NO_LEGAL if not (v.legal and c.legal) else OTHER_LEGAL
    if "acronym" in (v.kind, c.kind):
        if v.kind == c.kind:
            return legal if v.parts == c.parts else IMPOSSIBLE
        short, full = (v, c) if v.kind == "acronym" else (c, v)
        turns = [full.parts[i:] + full.parts[:i] for i in range(len(full.parts))] if full.unsure else [full.parts]
        return legal + ACRONYM if any("".join(p[0] for p in t) == short.parts[0] for t in turns) else IMPOSSIBLE
    if len(v.parts) != len(c.parts):
        return IMPOSSIBLE
    best = IMPOSSIBLE
    n = len(v.parts)
    for turn in range(n if v.unsure or c.unsure else 1):
        total = REORDER if turn else 0
        for i, a in enumerate(v.parts):
            b = c.parts[(i + turn) % n]
            cut = (len(a) != len(b)) and ((a.startswith(b) and len(b) >= 2) or (b.startswith(a) and len(a) >= 2)) and (
                (v.cut and v.cut[i]) or (c.cut and c.cut[(i + turn) % n])
            )
            total = _plus(total, _best(CUT_WORD if cut else IMPOSSIBLE, _typed(a, b)))
        best = _best(best, total)
    return _plus(best, legal)


def channel(v: NameForm, c: NameForm) -> int:
    """Operations by which the entity written c was written v, or IMPOSSIBLE."""
    if not v.kind or not c.kind:
        return IMPOSSIBLE
    if v.kind == "person" and c.kind == "person":
        return _person(v, c)
    if {v.kind, c.kind} == {"person", "org"}:
        p, o = (v, c) if v.kind == "person" else (c, v)
        if p.titled:
            return IMPOSSIBLE
        if p.middle and len(o.parts) == 3 and o.parts[1][0] == p.middle:  # 'Acme W. Foods' reads like a person with a middle initial
            return _plus(CUT_WORD, _typed(p.parts[0], o.parts[0]), _typed(p.parts[1], o.parts[2]))
        if not p.middle and o.legal and len(o.parts) == 2 and p.parts[0] not in NICKS:  # 'Acme Foods' reads like a person
            return _org(NameForm("org", p.parts), o)
        return IMPOSSIBLE
    if v.kind != "person" and c.kind != "person":
        return _org(v, c)
    return IMPOSSIBLE


def form_prior(f: NameForm) -> float:
    """Log probability that a canonical form has this form: few are abbreviated."""
    if f.kind == "acronym":
        return -9.0
    if f.kind == "org":
        return -4.0 * sum(f.cut) + 0.2 * bool(f.legal)
    given = f.parts[0]
    return (-11.0 if not given else -8.0 if len(given) == 1 else -4.0 if given in NICKS and given not in NICKS[given] else 0.0) + 0.2 * bool(f.middle)


def _deletions(part: str) -> set[str]:
    return {part} | ({part[:i] + part[i + 1 :] for i in range(len(part))} if len(part) >= 4 else set())


def _letters(given: str) -> set[str]:
    """Letters by which spellings of one given name meet: the first two, and the first ones of the full names it stands for."""
    return set(given[:2]) | {full[0] for full in NICKS.get(given, ())}


def block_keys(f: NameForm) -> list[str]:
    """Keys that spellings of one entity share.

    Persons: deletion neighbourhoods of a part that is no known given name, each with a letter of the given name, so that
    a common family name does not make one block. Spellings without given name meet all others of the family under keys
    with '*' (theirs begin with '!'), never each other's whole block. Organisations: first word, acronym letters.
    """
    if f.kind == "acronym":
        return ["#" + f.parts[0]]
    if f.kind == "org":
        turns = [f.parts[i:] + f.parts[:i] for i in range(len(f.parts))] if f.unsure else [f.parts]
        keys = {"#" + "".join(p[0] for p in t) for t in turns}
        # two of the parts together; a typo or a cut word spoils one of three at most
        return sorted(keys | {"o" + d for p in (f.parts if f.unsure else f.parts[:1]) for d in _deletions(p)})
    if f.kind == "person":
        given, family = f.parts
        if not given:
            return sorted("!" + d + "*" for d in _deletions(family))
        ways = [(given, family)] if family not in NICKS or not f.unsure else []
        if f.unsure and given not in NICKS and len(given) > 1:
            ways.append((family, given))
        ways = ways or [(given, family), (family, given)]
        keys = {"p" + d + x for g, part in ways for d in _deletions(part) for x in (*_letters(g), "*")}
        if not f.titled and given not in NICKS and len(given) > 1:
            keys |= {"o" + d for d in _deletions(given)} if f.middle else {"o" + given}
        return sorted(keys)
    return []


def _typed_as(logs: tuple[float, ...]) -> Column:
    """Log of the frequency prior of the candidate and of the likelihood that it was typed as the spelling."""
    total = F.col("together") * F.lit(LISTED_TOGETHER) + F.log("nc")
    for i, v in enumerate(logs):
        total = total + F.shiftright("ops", 4 * i).bitwiseAND(F.lit(15)) * F.lit(v)
    return total


def _parents(edges: DataFrame, logs: tuple[float, ...]) -> DataFrame:
    """(v, up, ops, nv): the maximum-posterior candidate of each spelling that is likelier than an entity of its own."""
    good = edges.withColumn("score", _typed_as(logs)).where(F.col("score") > F.lit(NEW_ENTITY) + F.log("nv"))
    best = F.max(F.struct((F.col("score") + F.col("pc")).alias("score"), "c", "ops", "nv")).alias("x")
    return good.groupBy("v").agg(best).select("v", F.col("x.c").alias("up"), F.col("x.ops").alias("ops"), F.col("x.nv").alias("nv"))


def link_spellings(spellings: DataFrame, listed: DataFrame, scope_cols: list[str], em_rounds: int = 2) -> DataFrame:
    """(scope columns, name, entity_key): every spelling that is a name with the canonical spelling of its entity.

    ``spellings`` has the scope columns, name and n (how often it is written); ``listed`` pairs (scope columns, a, b)
    of spellings given for one mention. Strings that are no names (roles, products, empty, null) do not come out.
    A spelling like no other is its own canonical form. Repeated rows must be summed in n; empty input, empty result.
    Pairs travel as 64-bit keys of (scope, name); the probabilities of the channel take em_rounds rounds of estimation,
    each one aggregate over the linked spellings.
    """
    s1, s2 = scope_cols
    z = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    base = spellings.select(z(s1).alias("s1"), z(s2).alias("s2"), "name", "n")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [parse_name(x) for x in b.column("name").to_pylist()]
            keys = pa.array([block_keys(f) for f in forms], pa.list_(pa.string()))
            prior = pa.array([form_prior(f) if f.kind else 0.0 for f in forms], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, prior, keys], names=["s1", "s2", "name", "n", "prior", "key"])

    nid = F.xxhash64("s1", "s2", "name").alias("nid")
    names = base.mapInArrow(keyed, "s1 string, s2 string, name string, n long, prior double, key array<string>").where(F.size("key") > 0)
    lone = F.transform("key", lambda k: F.struct(F.xxhash64("s1", "s2", F.when(F.startswith(k, F.lit("!")), F.concat(F.lit("p"), F.substr(k, F.lit(2)))).otherwise(k)).alias("block"), F.when(F.startswith(k, F.lit("!")), 2).when(F.endswith(k, F.lit("*")), 1).otherwise(0).cast("byte").alias("side")))
    names = materialize(names.select(nid, "s1", "s2", "name", "n", "prior", lone.alias("keys")), "names")
    exploded = names.select("nid", F.inline("keys"))
    a, b = exploded.select("block", F.col("nid").alias("a"), F.col("side").alias("sa")), exploded.select("block", F.col("nid").alias("b"), F.col("side").alias("sb"))
    # full spellings (1) meet those without given name (2) under '*', not each other
    met = a.join(b, "block").where((F.col("a") < F.col("b")) & ((F.col("sa") != 1) | (F.col("sb") != 1))).select("a", "b", F.lit(0).alias("together"))
    la, lb = F.xxhash64("s1", "s2", "a"), F.xxhash64("s1", "s2", "b")
    near = listed.where("a <> b").select(z(s1).alias("s1"), z(s2).alias("s2"), "a", "b").select(F.least(la, lb).alias("a"), F.greatest(la, lb).alias("b"), F.lit(1).alias("together"))
    pairs = met.unionByName(near).groupBy("a", "b").agg(F.max("together").alias("together"))
    of = lambda x: names.select(F.col("nid").alias(x), F.col("name").alias(f"name_{x}"), F.col("n").alias(f"n_{x}"), F.col("prior").alias(f"prior_{x}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    pairs = pairs.select("a", "name_a", "n_a", "prior_a", "b", "name_b", "n_b", "prior_b", "together")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            rows = []
            for x, na, ka, pa_, y, nb, kb, pb, together in zip(*(c.to_pylist() for c in d.columns)):
                # the spelling of the greater prior is the candidate
                if (math.log(ka) + pa_, ka, na) > (math.log(kb) + pb, kb, nb):
                    x, na, ka, pa_, y, nb, kb, pb = y, nb, kb, pb, x, na, ka, pa_
                ops = channel(parse_name(na), parse_name(nb))
                if ops >= 0:
                    rows.append((x, y, ops, together, ka, kb, pb))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["v", "c", "ops", "together", "nv", "nc", "pc"])

    edges = materialize(pairs.mapInArrow(score, "v long, c long, ops long, together int, nv long, nc long, pc double"), "name_edges")
    logs = FIRST
    written = names.agg(F.sum("n")).first()[0] or 0 if em_rounds else 0
    for _ in range(em_rounds if written else 0):
        uses = [F.coalesce(F.sum(F.shiftright("ops", 4 * i).bitwiseAND(F.lit(15)) * F.col("nv")), F.lit(0)).alias(f"u{i}") for i in range(len(OPS))]
        seen = _parents(edges, logs).agg(*uses).first()
        logs = tuple(FIRST[i] if name in _FIXED else math.log(min(0.9, (seen[i] + 50 * p) / (written + 50))) for i, (name, p) in enumerate(OPS.items()))
    parent = _parents(edges, logs).select(F.col("v").alias("nid"), "up")
    roots = materialize(names.select("nid").join(parent, "nid", "left").select("nid", F.coalesce("up", "nid").alias("up")), "name_parents")
    for _ in range(40):  # pointer doubling; chains rise in prior, so they end
        up = roots.select(F.col("nid").alias("up"), F.col("up").alias("upper"))
        roots = materialize(roots.join(up, "up").select("nid", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), "name_roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    else:
        raise RuntimeError("spellings form a chain of more than 2**40 links")
    top = names.select(F.col("nid").alias("up"), F.col("name").alias("entity_key"))
    null = lambda c, n: F.when(F.col(c) != "\x00", F.col(c)).alias(n)
    return names.select("nid", "s1", "s2", "name").join(roots.select("nid", "up"), "nid").join(top, "up").select(null("s1", s1), null("s2", s2), "name", "entity_key")


def name_mentions(items: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings, listed) of the tables: distinct strings with counts per tenant and scope, and strings of one mention."""
    items = items.dropDuplicates(["item_id", "name"]) if "item_id" in items.columns else items
    alias = items.select("tenant_id", "scope", F.col("name").alias("a"), F.explode("aliases").alias("name"))
    every = items.select("tenant_id", "scope", "name").unionByName(alias.select("tenant_id", "scope", "name")).unionByName(facts.select("tenant_id", "scope", F.col("subject").alias("name")))
    spellings = every.where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("tenant_id", "scope", "name").agg(F.count(F.lit(1)).alias("n"))
    listed = alias.where(F.col("a").isNotNull() & F.col("name").isNotNull()).select("tenant_id", "scope", "a", F.col("name").alias("b"))
    return spellings, listed


def spelling_pairs(linked: DataFrame, scope_cols: list[str]) -> DataFrame:
    """All pairs (scope columns, name_a, name_b), name_a < name_b by code point, of one entity."""
    s1, s2 = scope_cols
    z = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    a = linked.select(z(s1).alias("s1"), z(s2).alias("s2"), "entity_key", F.col("name").alias("name_a"))
    b = linked.select(z(s1).alias("s1"), z(s2).alias("s2"), "entity_key", F.col("name").alias("name_b"))
    pairs = a.join(b, ["s1", "s2", "entity_key"]).where("name_a < name_b")
    null = lambda c, n: F.when(F.col(c) != "\x00", F.col(c)).alias(n)
    return pairs.select(null("s1", s1), null("s2", s2), "name_a", "name_b")
