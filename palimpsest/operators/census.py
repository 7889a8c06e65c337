"""Structured ledgers by category: what a question counts, the live events it selects, budgets, numeric answers.

Records have corpus, ord (order of arrival), operation, session_type, date, details (JSON with category or subcategory,
item, old_item, preference) and memory_text (what was shared to be remembered). A question sees the records before its
prefix. Mutable lists are folded by the identity of an item with windows per identity; measurements keep every event.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import modes as M
from palimpsest.functions import text as T
from palimpsest.functions.patterns import pattern

# Categories of preference domains, words that tell a domain, and words of items that hint at one.
DOMAINS = {
    "movie": ["genres", "actors", "directors", "already_watched_list"], "book": ["genres", "authors", "topics", "already_read_list"],
    "music": ["genres", "artists", "decades", "already_listened_list"], "travel": ["regions", "destination_types", "climates", "already_visited_list"],
}
DOMAIN_WORDS = {
    "movie": "movie movies film films cinema watch watched watching drama dramas comedy comedies".split(), "book": "book books author authors novel novels read reads reading readings".split(),
    "music": "music musics song songs album albums artist artists listen listens listened listening".split(),
    "travel": ["travel", "travels", "trip", "trips", "visit", "visits", "place", "places", "destination", "destinations", "where should i go"],
}
ITEM_HINTS = {
    "movie": ["drama", "dramas", "comedy", "comedies", "western", "westerns", "cyberpunk", "space opera", "thriller", "thrillers", "noir", "romance", "horror"],
    "music": ["bebop", "jazz", "folk", "lo-fi", "classical", "swing", "minimalism", "rock", "pop", "hip hop", "hip-hop", "hiphop", "r&b", "opera", "metal", "symphony"],
}
MUTABLE = sorted({"todo_list", "calendar_event", *(c for cs in DOMAINS.values() for c in cs)})
EXPLICIT = {c: c for c in "genres topics authors actors directors artists decades regions climates".split()} | {"destination types": "destination_types", "preferred types": "destination_types"}
NEGATIVE = ["delete", "remove", "forget", "cancel"]
MEALS = ["coffee", "lunch", "breakfast", "dinner", "grocery"]
# Questions about totals, and questions that ask for a choice.
AGGREGATE = [
    "total", "sum", "average", "how many", "how much", "spent", "spending", "expense", "expenses", "most", "least", "maximum", "minimum", "across the", "across all",
    "which week .. highest", "which week .. lowest", "which month .. highest", "which month .. lowest", "which day .. highest", "which day .. lowest", "meeting my .. goal",
]
CHOICE = [
    "where should i travel", "where should i go", "what should i read", "what should i watch", "what should i listen to", "help me choose", "pick a", "pick some", "idea for a", "ideas for a", "idea for my",
    "ideas for my", "recommend", "recommendation", "recommendations", "recommended", "suggest", "suggestion", "suggestions", "suggested",
]
# Words that stand for others in a question, and the vocabulary of an anchor word.
ALIASES = {
    "spend": "expense expenses amount cost", "spending": "expense expenses amount cost", "spent": "expense expenses amount cost", "food": "breakfast lunch dinner coffee snack", "task": "tasks todo description",
    "tasks": "task todo description", "todo": "task tasks description", "steps": "step stepcount step_count", "books": "book reading read", "book": "books author authors genre genres read reading already",
    "movies": "movie film films genre genres actor actors director directors watched", "movie": "movies film films genre genres actor actors director directors watched",
    "music": "artist artists genre genres decade decades listened", "destination": "destinations visited country countries travel types", "destinations": "destination visited country countries travel types",
    "travel": "destination destinations visited country countries types", "preferences": "preference prefer preferred like",
}
_PLACES = "destination destinations travel trip visited country countries region regions site sites climate climates types"
ANCHORS = {
    "movie": "movie movies film films actor actors director directors watched", "book": "book books author authors read reading", "music": "music song songs album albums artist artists listened decade decades",
    "destination": "destination destinations travel visited country countries region regions site sites climate climates ceremony ceremonies archaeological", "travel": _PLACES, "visit": _PLACES, "place": _PLACES,
}


def phrases(words: list[str]) -> str:
    """One pattern over lower-case text of whole words; ``a .. b`` means that b follows a."""
    return pattern(", ".join(words))


def _says(text: Column, words: list[str]) -> Column:
    return F.rlike(F.lower(text), F.lit(phrases(words)))


def asks_aggregate(query: Column) -> Column:
    return _says(query, AGGREGATE)


def asks_census(query: Column) -> Column:
    """A question about a set, a total or a choice."""
    return M.matches(query, "broad_set") | asks_aggregate(query) | _says(query, CHOICE)


def census_budgets(query: Column, sources: Column, ledger: Column | None = None, default: int = 32, fallback: int = 48) -> dict[str, Column]:
    """How many sources a question may take: of the coverage law, the census law, the collapsed census, the ledger."""
    broad, past = M.matches(query, "broad_set"), M.matches(query, "historical")
    capped = lambda n: F.least(sources, n if isinstance(n, Column) else F.lit(n))
    galactic = F.when(asks_aggregate(query), 512).when(broad, 160).when(past, 96).otherwise(default)
    out = {
        "facts": F.when(broad, 48).when(past, 24).otherwise(16), "census": capped(galactic),
        "collapsed": capped(F.when(asks_aggregate(query), 768).when(_says(query, CHOICE), 1024).otherwise(galactic)),
    }
    if ledger is not None:
        out["ledger"] = capped(F.when(asks_census(query) & (ledger > 0), ledger + fallback).otherwise(fallback))
    return out


def _terms(words: str) -> list[str]:
    """Stemmed terms of a fixed word list, by the rule of the retrieval tokenizer."""
    out = []
    for w in words.replace("_", " ").split():
        cut = next((w[: -len(s)] + ("y" if s in ("ied", "ies") else "") for s in T.SUFFIXES if w.endswith(s) and len(w) - len(s) >= 4), w)
        if cut not in T.RETRIEVAL_STOP and len(cut) > 1:
            out.append(cut)
    return out


def _told(terms: Column, table: dict[str, str]) -> Column:
    """The terms of all entries of a table that the terms name."""
    empty = F.array().cast("array<string>")
    parts = [F.when(F.arrays_overlap(terms, F.array(*[F.lit(t) for t in _terms(k)])), F.array(*[F.lit(t) for t in _terms(v)])).otherwise(empty) for k, v in table.items() if _terms(k)]
    return F.concat(*parts)


def expanded_terms(query: Column) -> Column:
    """Terms of a question, those they stand for, and terms without a final s."""
    single = lambda terms: F.transform(F.filter(terms, lambda t: F.endswith(t, F.lit("s")) & (F.length(t) > 3)), lambda t: F.left(t, F.length(t) - 1))
    return T._once(T.retrieval_terms(query), lambda terms: F.array_sort(F.array_distinct(F.concat(terms, _told(terms, ALIASES), single(terms)))))


def domain_terms(query: Column) -> Column:
    """The vocabulary of the anchor words that a question names."""
    return T._once(T.retrieval_terms(query), lambda terms: F.array_sort(F.array_distinct(_told(terms, ANCHORS))))


def is_invalidation(text: Column) -> Column:
    """A record that deletes, forgets or cancels something."""
    return F.rlike(F.lower(text), F.lit(r"\boperation\s+(?:delete|remove|forget|cancel)|\bstatus\s+(?:deleted|removed|forgotten|cancelled|canceled|obsolete)\b"))


def census_score(kind: Column, historical: Column, invalid: Column, fields: dict[str, Column]) -> Column:
    """Score of a source for a question of kind aggregate, broad or plain; fields in [0, 1] but the contact counts.

    fields: force, semantic, lexical, contact (share of the question's terms), exact (their number), domain (terms of the
    domain), recency, positive. Invalidations fall behind unless the question is about the past.
    """
    f = lambda k: F.coalesce(fields.get(k, F.lit(0.0)), F.lit(0.0))
    aggregate = 0.37 * f("lexical") + 0.20 * f("force") + 0.13 * f("semantic") + 0.22 * f("contact") + 0.02 * F.least(F.lit(4), f("exact")) + 0.06 * f("positive")
    broad = 0.30 * f("lexical") + 0.22 * f("force") + 0.14 * f("semantic") + 0.20 * f("contact") + 0.08 * f("recency") + 0.06 * f("positive") + 0.62 * (f("domain") > 0).cast("double") + 0.03 * F.least(F.lit(4), f("domain"))
    plain = 0.43 * f("force") + 0.34 * f("semantic") + 0.23 * f("lexical")
    return F.when(kind == "aggregate", aggregate).when(kind == "broad", broad).otherwise(plain) - F.when(invalid & ~historical, 2.0).otherwise(0.0)


# --- the ledger -------------------------------------------------------------------------------------------------------


def _json(path: str) -> Column:
    return F.get_json_object("details", f"$.{path}")


def record_category() -> Column:
    return F.lower(F.coalesce(_json("category"), _json("subcategory"), F.col("session_type"), F.lit("")))


def _identity(item):
    """Stable part of an item: its name, else its fields without those that may change."""
    if isinstance(item, dict):
        named = next((f for f in ("description", "event_name", "name", "title", "id") if f in item), None)
        if named:
            return [named, _identity(item[named])]
        return sorted([k, _identity(v)] for k, v in item.items() if k not in ("created_at", "updated_at", "date", "preference"))
    return [_identity(x) for x in item] if isinstance(item, list) else str(item).strip().casefold()


def item_identity(json_text: Column) -> Column:
    """Identity of an item given as JSON; plain text is its own item; null has none."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(_identity(json.loads(x)), ensure_ascii=False)
        except ValueError:
            return json.dumps(_identity(x), ensure_ascii=False)

    return F.pandas_udf(lambda s: s.map(one), "string")(json_text)


def record_domain() -> Column:
    """Preference domain of a record: by its category, the words shared, or hints of its item."""
    out = F.when(F.lit(False), "")
    for d, cs in DOMAINS.items():
        out = out.when(F.col("category").isin([c for c in cs if c != "genres"]), d)
    text = F.lower(F.coalesce("memory_text", F.lit("")))
    counts = {d: F.size(F.regexp_extract_all(text, F.lit(phrases(w)), F.lit(0))) for d, w in DOMAIN_WORDS.items()}
    most = reduce(F.greatest, counts.values())
    for d, n in counts.items():
        out = out.when((n == most) & (most > 0), d)
    for d, w in ITEM_HINTS.items():
        out = out.when(_says(F.coalesce(_json("item"), F.lit("")), w), d)
    return out


def question_categories(query: Column, known: Column) -> Column:
    """Ledger categories that a question asks for; ``known`` are all of its corpus, the last resort by whole phrases."""
    low = F.lower(query)
    say = lambda *w: F.rlike(low, F.lit(phrases(list(w))))
    rules = [
        (say("todo", "to-do", "task remain", "tasks remain", "remaining task", "remaining tasks"), ["todo_list"]), (say("calendar", "upcoming event", "upcoming events", "event do i have", "events do i have"), ["calendar_event"]),
        (say("spend", "spent", "spending", "expense", "expenses", "food", *MEALS), ["food_expenses"]), (say("step", "steps", "walking"), ["step_tracker"]),
        (say("step", "steps", "walking") & (F.contains(low, F.lit("goal")) | F.contains(low, F.lit("daily"))), ["daily_steps"]),
        *[(F.contains(low, F.lit("budget")) & F.contains(low, F.lit(m)), [m]) for m in MEALS], *[(say(*w), DOMAINS[d]) for d, w in DOMAIN_WORDS.items()],
    ]
    empty = F.array().cast("array<string>")
    add = lambda acc, rule: F.concat(acc, F.when(rule[0], F.array(*[F.lit(c) for c in rule[1]])).otherwise(empty))
    told = reduce(add, rules, empty)
    explicit = reduce(add, [(F.contains(low, F.lit(t)), [c]) for t, c in EXPLICIT.items()], empty)
    terms = T.retrieval_terms(F.replace(query, F.lit("_"), F.lit(" ")))
    whole = F.filter(known, lambda c: (F.size(T.retrieval_terms(F.replace(c, F.lit("_"), F.lit(" ")))) > 0) & (F.size(F.array_except(T.retrieval_terms(F.replace(c, F.lit("_"), F.lit(" "))), terms)) == 0))
    return F.array_distinct(F.when(F.size(explicit) > 0, explicit).when(F.size(told) > 0, told).otherwise(whole))


def ledger_events(records: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ord, origin, category, and the record): the live events of each question's visible ledger.

    Measurements: every positive event is its own origin. Mutable lists: the last record of an item that was not deleted
    or replaced since; its origin is the first record of the item on the day of the first one after the last deletion.
    """
    r = records.where("operation is not null and ord is not null").withColumn("category", record_category())
    r = r.where((F.col("category") != "no_memory") & (F.lower(F.coalesce("session_type", F.lit(""))) != "no_memory") & (F.col("details").isNull() | F.startswith(F.trim("details"), F.lit("{"))))
    r = r.withColumns({"op": F.lower("operation"), "domain": record_domain(), "i": F.coalesce(item_identity(_json("item")), F.lit("none")), "old": item_identity(_json("old_item"))})
    j = r.join(queries.select("corpus", "query_id", "prefix"), "corpus").where(F.col("ord") < F.col("prefix"))
    negative, mutable = F.col("op").isin(NEGATIVE), F.col("category").isin(MUTABLE)
    keep = ["query_id", "ord", "origin", "category", "date", "details", "domain", "operation", "first_domain"]
    measured = j.where(~mutable & ~negative).withColumns({"origin": F.col("ord"), "first_domain": F.col("domain")}).select(*keep)
    m = j.where(mutable & (negative | F.col("op").isin("add", "update")))
    replaced = (F.col("op") == "update") & F.col("old").isNotNull() & (F.col("old") != F.col("i"))
    own = m.withColumns({"key": F.col("i"), "gone": negative})
    away = m.where(replaced).withColumns({"key": F.col("old"), "gone": F.lit(True)})
    e = own.unionByName(away)
    by = Window.partitionBy("query_id", "category", "key").orderBy("ord", F.col("gone").desc())
    e = e.withColumn("life", F.sum(F.col("gone").cast("int")).over(by)).where("not gone")
    day = F.min("ord").over(Window.partitionBy("query_id", "category", "key", F.coalesce("date", F.lit(""))))
    e = e.withColumn("day_first", day)
    last_life = F.max("life").over(Window.partitionBy("query_id", "category", "key"))
    ends = own.unionByName(away).where("gone").groupBy("query_id", "category", "key").agg(F.max("ord").alias("ended"))
    e = e.withColumn("last_life", last_life).where("life = last_life")
    rec = F.struct("ord", "date", "details", "domain", "operation")
    g = e.groupBy("query_id", "category", "key").agg(F.max_by(rec, "ord").alias("x"), F.min_by("day_first", "ord").alias("origin")).join(ends, ["query_id", "category", "key"], "left")
    g = g.where(F.col("ended").isNull() | (F.col("x.ord") >= F.col("ended"))).select("query_id", "category", "origin", "x.*")
    first = j.select("query_id", F.col("ord").alias("origin"), F.col("domain").alias("first_domain"))
    return measured.unionByName(g.join(first, ["query_id", "origin"], "left").select(*keep))


def ledger_select(records: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ord): sources of the live events that a question asks for, each once.

    Questions with a time (as_of) leave out calendar events that are over; "which month .. last n months" counts 30 days
    for each month from the first record on; genres are kept to the domains the question names, expenses to the meal.
    """
    known = records.withColumn("category", record_category()).groupBy("corpus").agg(F.collect_set("category").alias("known"))  # a handful of names
    q = queries.join(known, "corpus").withColumn("categories", question_categories(F.col("query"), F.col("known")))
    low = F.lower(F.col("query"))
    domains = F.filter(F.array(*[F.when(_says(F.col("query"), w), F.lit(d)) for d, w in DOMAIN_WORDS.items()]), lambda x: x.isNotNull())
    meal = F.when(F.lit(False), "")
    for x in MEALS:
        meal = meal.when(F.contains(low, F.lit(x)), x)
    months = F.when(F.contains(low, F.lit("which month")), F.regexp_extract(low, r"\blast\s+(\d+)\s+months?\b", 1).try_cast("int"))
    start = records.join(queries.select("corpus", "query_id", "prefix"), "corpus").where(F.col("ord") < F.col("prefix")).groupBy("query_id").agg(F.min(F.to_date(F.try_to_timestamp("date"))).alias("start"))
    q = q.withColumns({"domains": domains, "meal": meal, "months": months}).join(start, "query_id", "left").select("query_id", "categories", "domains", "meal", "months", "start", "as_of")
    e = ledger_events(records, queries).join(q, "query_id").where(F.array_contains("categories", F.col("category")))
    domain = F.coalesce("domain", "first_domain")
    day = F.to_date(F.try_to_timestamp("date"))
    item_day, created = _json("item.date"), F.to_date(F.try_to_timestamp(F.coalesce(_json("item.created_at"), F.col("date"))))
    offset = F.regexp_extract(item_day, r"^\+(\d+) days?$", 1).try_cast("int")
    due = F.when(offset.isNotNull(), F.date_add(created, offset)).otherwise(F.to_date(F.try_to_timestamp(item_day)))
    ok = ~((F.size("domains") > 0) & (F.col("category") == "genres") & domain.isNotNull() & ~F.array_contains("domains", domain))
    ok &= ~(F.col("meal").isNotNull() & (F.col("category") == "food_expenses") & (F.lower(F.coalesce(_json("item.expense_type"), F.lit(""))) != F.col("meal")))
    ok &= ~(F.col("months").isNotNull() & F.col("category").isin("food_expenses", "step_tracker") & day.isNotNull() & F.col("start").isNotNull() & ~((day >= F.col("start")) & (day < F.date_add("start", 30 * F.col("months")))))
    ok &= ~((F.col("category") == "calendar_event") & F.col("as_of").isNotNull() & due.isNotNull() & (due <= F.to_date(F.try_to_timestamp("as_of"))))
    return e.where(F.coalesce(ok, F.lit(True))).select("query_id", F.col("origin").alias("ord")).distinct()


def numeric_answers(records: DataFrame, selected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, phase, value, count, unit): totals and best periods of steps and expenses of the selected records.

    Questions about goals and budgets have none. Steps: the total, else the week of the month or the month of the
    greatest sum ("last 3 months": the first three windows of 30 days). Expenses: the total of the meal named, or all.
    """
    low = F.lower(F.col("query"))
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in w])
    q = queries.where(~has("goal", "budget", "meet my", "meeting my"))
    meal = F.when(F.lit(False), "")
    for x in MEALS:
        meal = meal.when(F.contains(low, F.lit(x)), x)
    kind = F.when(has("step") & (F.rlike(low, F.lit(r"\btotal\b|how many"))), "steps").when(has("step") & has("week"), "week").when(has("step") & has("month") & has("last 3 months"), "window").when(has("step") & has("month"), "month")
    kind = kind.when(F.rlike(low, F.lit(r"\b(?:spend|spent|spending|expenses?)\b")), "expenses")
    q = q.select("corpus", "query_id", kind.alias("kind"), meal.alias("meal")).where("kind is not null")
    r = records.withColumn("category", record_category()).select("corpus", "ord", "category", "date", "details")
    j = q.join(selected, "query_id").join(r, ["corpus", "ord"])
    day = F.to_date(F.try_to_timestamp("date"))
    origin = F.min(day).over(Window.partitionBy("query_id"))
    steps = F.col("kind") != "expenses"
    value = F.when(steps & (F.col("category") == "step_tracker"), _json("item.step_count").try_cast("double")).when(~steps & (F.col("category") == "food_expenses"), _json("item.amount").try_cast("double"))
    week = F.concat(F.date_format(day, "yyyy-MM"), F.lit("-W"), F.floor((F.day(day) - 1) / 7 + 1).cast("string"))
    window = F.concat(F.lit("W"), F.floor(F.datediff(day, origin) / 30 + 1).cast("string"))
    phase = F.when(F.col("kind") == "week", week).when(F.col("kind") == "month", F.date_format(day, "yyyy-MM")).when(F.col("kind") == "window", window).otherwise("")
    rows = j.withColumns({"v": value, "phase": phase}).where("v is not null and phase is not null").where((F.col("kind") != "window") | F.col("phase").isin("W1", "W2", "W3"))
    own = (F.col("kind") == "expenses") & F.col("meal").isNotNull()
    rows = rows.withColumn("match", ~own | (F.lower(F.coalesce(_json("item.expense_type"), F.lit(""))) == F.col("meal")))
    some = F.max(F.col("match").cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("some", some).where(F.col("match") | (F.col("some") == 0))
    s = rows.groupBy("query_id", "kind", "phase").agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("count"))
    best = s.groupBy("query_id", "kind").agg(F.max(F.struct("value", F.col("phase"), "count")).alias("b"))
    return best.select("query_id", F.nullif(F.col("b.phase"), F.lit("")).alias("phase"), F.col("b.value").alias("value"), F.col("b.count").alias("count"), F.when(F.col("kind") == "expenses", "currency").otherwise("steps").alias("unit"))


def census_six(rows: DataFrame, category: str, field: str, at: str, dimension: str, member: str, value: str) -> DataFrame:
    """Counts and sums of one pass over six groupings of (category, field): alone, by month, week of month, 30-day window,
    member of a dimension, and member with window. ``level`` names the grouping; other columns are null there. Windows
    start at the earliest time of all rows."""
    start = rows.agg(F.min(at)).first()[0]
    day = F.col(at)
    t = rows.select(
        F.col(category).alias("category"), F.col(field).alias("field"), F.date_format(day, "yyyy-MM").alias("month"), F.concat(F.date_format(day, "yyyy-MM"), F.lit("-W"), F.floor((F.dayofmonth(day) - 1) / 7 + 1).cast("string")).alias("week"),
        F.concat(F.lit("W"), F.floor(F.datediff(day, F.lit(start)) / 30 + 1).cast("string")).alias("window"), F.col(dimension).alias("dimension"), F.col(member).alias("member"), F.col(value).cast("double").alias("v"),
    )
    base = ["category", "field"]
    cols = [*base, "month", "week", "window", "dimension", "member"]
    sets = {"all": base, "month": [*base, "month"], "week": [*base, "week"], "window": [*base, "window"], "member": [*base, "dimension", "member"], "member window": [*base, "dimension", "member", "window"]}
    g = t.groupingSets(list(sets.values()), *cols).agg(F.count("v").alias("count"), F.sum("v").alias("sum"), F.grouping_id().alias("_g"))
    bits = {name: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keys) for name, keys in sets.items()}
    level = reduce(lambda w, kv: w.when(F.col("_g") == kv[1], kv[0]), bits.items(), F.when(F.lit(False), ""))
    return g.select(level.alias("level"), *cols, "count", "sum")
