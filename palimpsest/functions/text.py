"""Text functions as column expressions: tokens, stems, character features, entities, cues, risk.

Everything here stays in the JVM. Each builder has a twin that renders the same rule as DuckDB SQL, which the oracle
queries use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the memory tokenizer, and of the retrieval tokenizer.
MEMORY_STOP = "a an and are as at be by for from has have i in is it my of on or the this to was we with you your".split()
RETRIEVAL_STOP = (
    "a an and are as at be been but by did do does for from had has have he her hers him his how i in is it its me my of on or our she that the their "
    "them they this to was we were what when where which who why will with would you your"
).split()
# Suffixes in the order in which they are tried; ied and ies leave a y.
SUFFIXES = "ingly edly ation ments ment ness ing ied ies ed es s".split()
# Cue words.
NEGATIONS = ["not", "never", "no", "without", "不是", "不再", "没有", "取消"]
CORRECTION_CUES = ["actually", "correction", "correct", "changed", "instead", "更正", "改为", "其实", "更新"]
FUTURE_CUES = ["remember", "remind", "later", "deadline", "tomorrow", "以后", "记住", "提醒", "截止", "将来"]
PREFERENCE_CUES = ["prefer", "favorite", "like", "dislike", "偏好", "喜欢", "讨厌", "最爱"]
EVENT_CUES = ["yesterday", "today", "tomorrow", "昨天", "今天", "明天"]
ACTION_CUES = ["must", "should", "todo", "call", "send", "需要", "必须", "联系", "发送"]
INJECTION_CUES = ["ignore previous", "ignore all", "system prompt", "reveal secret", "developer message", "override instructions", "忽略之前", "系统提示词", "泄露密钥", "覆盖指令"]
INJECTION_COMPACT = (
    "ignoreprevious ignoreall ignorepriorguidance ignorepriorinstructions systemprompt revealsecret exposehiddenconfiguration exposehiddenprompt developermessage overrideinstructions"
).split()
OBFUSCATED = "ignorepriorguidance ignorepriorinstructions exposehiddenconfiguration exposehiddenprompt".split()
COMMAND_CUES = ["must", "execute", "send", "delete", "运行", "执行", "发送", "删除"]
SECRET_CUES = ["password", "token", "secret", "api key", "密码", "密钥"]

MEMORY_WORD = "[A-Za-z0-9]+|[㐀-鿿]+"
# Whole tokens are matched, as word boundaries mean different things in different regular expression engines.
CAPITALIZED = "^[A-Z][A-Za-z0-9_-]{2,}$"
VALUE_ITEM = "^(?:[A-Z][A-Za-z0-9_.-]{2,}|[A-Za-z]+[-_.:/][0-9][A-Za-z0-9_.:/-]*|[0-9]+(?:[.][0-9]+)+|[0-9]{2,})$"
_WORD_SPLIT, _ITEM_SPLIT = "[^A-Za-z0-9_-]+", "(?:[.:/-]*[^A-Za-z0-9_.:/-]+[.:/-]*|[.:/-]+$)"
# The same items in one pass: what fills a run of item letters but for the marks around it; only at the start of a text do marks stay.
_ITEM = f"(?:^|(?<=[^A-Za-z0-9_.:/-])[.:/-]*)({VALUE_ITEM[1:-1]})(?<![.:/-])(?=[.:/-]*(?:[^A-Za-z0-9_.:/-]|\\z))"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def memory_tokens(text: Column | str) -> Column:
    """Lower-case words and Chinese runs without stop words; null stays null, an empty text has none."""
    return F.filter(F.transform(F.regexp_extract_all(_c(text), F.lit(MEMORY_WORD), F.lit(0)), lambda w: F.lower(w)), lambda w: ~w.isin(MEMORY_STOP))


def stem(word: Column) -> Column:
    """The first suffix of the list that leaves at least four letters is cut."""
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        cut = F.left(word, F.length(word) - len(s))
        out = out.when(F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 4), F.concat(cut, F.lit("y")) if s in ("ied", "ies") else cut)
    return out.otherwise(word)


_MARK = "\x01"


def stemmed_text(text: Column | str) -> Column:
    """Lower-case text with every ASCII word stemmed, in two passes of one regular expression each.

    The shortest prefix of four letters or more before a suffix is kept, which is the first suffix of the list that
    fits. Words that end in ied or ies get their y behind a mark, so that the second pass leaves them alone.
    """
    rest = "|".join(x for x in SUFFIXES if x not in ("ied", "ies"))
    marked = F.regexp_replace(F.lower(_c(text)), "(?<![a-z0-9])([a-z0-9]{4,}?)(?:ied|ies)(?![a-z0-9])", f"$1{_MARK}y")
    return F.translate(F.regexp_replace(marked, f"(?<![a-z0-9])([a-z0-9]{{4,}}?)(?:{rest})(?![a-z0-9{_MARK}])", "$1"), _MARK, "")


def content_words(text: Column | str) -> Column:
    """Stemmed ASCII words of more than one letter that are no stop words."""
    return F.filter(F.regexp_extract_all(stemmed_text(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(RETRIEVAL_STOP) & (F.length(w) > 1))


def _once(value: Column, use) -> Column:
    """``use(value)`` with value evaluated once: bound as the variable of a lambda over a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def retrieval_terms(text: Column | str) -> Column:
    """Content words followed by their adjacent pairs."""

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b)))

    return _once(content_words(text), both)


def char_terms(text: Column | str) -> Column:
    """Padded character trigrams of words of four letters or more."""
    words = F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(RETRIEVAL_STOP) & (F.length(w) >= 4))

    def grams(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.concat(F.lit("c3:"), F.substr(p, i, F.lit(3))))

    return F.flatten(F.transform(words, lambda w: _once(F.concat(F.lit("^"), w, F.lit("$")), grams)))


def has_cue(text: Column | str, cues: list[str], tokens: Column | None = None) -> Column:
    """A Latin cue counts as a whole token, a Chinese or many-word cue as a substring.

    ``tokens``, if given, are the text's memory tokens, so that several cues share them.
    """
    lower, tokens = F.lower(_c(text)), memory_tokens(text) if tokens is None else tokens
    loose = [c for c in cues if " " in c or not c.isascii()]
    strict = [c for c in cues if c not in loose]
    out = F.arrays_overlap(tokens, _strings(strict)) if strict else F.lit(False)
    for c in loose:
        out = out | F.contains(lower, F.lit(c))
    return out


def _count(text: Column, cues: list[str]) -> Column:
    total = F.lit(0)
    for c in cues:
        total = total + F.contains(text, F.lit(c)).cast("int")
    return total


def injection_risk(text: Column | str) -> Column:
    """Share of instruction-injection cues, in [0, 1], of a text that is already in plain form."""
    lower = F.lower(_c(text))
    compact = F.regexp_replace(lower, "[^a-z0-9㐀-鿿]+", "")
    raw = 0.58 * (_count(lower, INJECTION_CUES) + _count(compact, INJECTION_COMPACT)) + 0.16 * _count(compact, OBFUSCATED) + 0.10 * _count(lower, COMMAND_CUES) + 0.14 * _count(lower, SECRET_CUES)
    return F.least(F.lit(1.0), raw)


def memory_kind(text: Column | str, requested: Column | str) -> Column:
    """The requested kind, else preference, instruction, event or fact by cue."""
    lower = F.lower(_c(text))
    event = F.lit(False)
    for c in EVENT_CUES:
        event = event | F.contains(lower, F.lit(c))
    own = F.when(has_cue(text, PREFERENCE_CUES), "preference").when(has_cue(text, FUTURE_CUES), "instruction").when(event, "event").otherwise("fact")
    return F.coalesce(F.when(_c(requested) != "", _c(requested)), own)


def text_entities(text: Column | str, supplied: Column | str | None = None, limit: int = 24) -> Column:
    """Supplied names, capitalized words and Chinese runs of two to eight letters, lower-case, in order, the first 24."""
    found = F.transform(F.filter(F.split(_c(text), _WORD_SPLIT), lambda w: F.rlike(w, F.lit(CAPITALIZED))), lambda w: F.lower(w))
    chinese = F.regexp_extract_all(_c(text), F.lit("[㐀-鿿]{2,8}"), F.lit(0))
    parts = [F.coalesce(found, F.array().cast("array<string>")), F.coalesce(chinese, F.array().cast("array<string>"))]
    if supplied is not None:
        names = F.filter(F.transform(_c(supplied), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
        parts.append(F.coalesce(names, F.array().cast("array<string>")))
    return F.slice(F.array_sort(F.array_distinct(F.concat(*parts))), 1, limit)


def value_items(text: Column | str) -> Column:
    """Identifiers, numbers and capitalized names of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(_ITEM), F.lit(1)))


def overlap_share(query: Column, items: Column) -> Column:
    """Share of the query's items that occur among the others."""
    return F.size(F.array_intersect(query, items)) / F.greatest(F.lit(1), F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where one is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def bounded_sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


# --- the same rules as DuckDB SQL ---------------------------------------------------------------------------------


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_memory_tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{MEMORY_WORD}'), lambda w: lower(w)), lambda w: w NOT IN {_in(MEMORY_STOP)})"


def sql_stem(w: str) -> str:
    parts = []
    for s in SUFFIXES:
        cut = f"left({w}, length({w}) - {len(s)})"
        parts.append(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 4 THEN {cut + ' || ' + chr(39) + 'y' + chr(39) if s in ('ied', 'ies') else cut}")
    return f"CASE {' '.join(parts)} ELSE {w} END"


def sql_content_words(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: {sql_stem('w')}), lambda w: w NOT IN {_in(RETRIEVAL_STOP)} AND length(w) > 1)"


def sql_retrieval_terms(words: str) -> str:
    """From an expression of content words."""
    return f"list_concat({words}, CASE WHEN len({words}) > 1 THEN list_transform(range(1, len({words})), lambda i: ({words})[i] || '_' || ({words})[i + 1]) ELSE [] END)"


def sql_char_terms(x: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN {_in(RETRIEVAL_STOP)} AND length(w) >= 4)"
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 1), lambda i: 'c3:' || substr('^' || w || '$', i, 3))))"


def sql_has_cue(x: str, cues: list[str]) -> str:
    loose = [c for c in cues if " " in c or not c.isascii()]
    strict = [c for c in cues if c not in loose]
    parts = [f"list_has_any({sql_memory_tokens(x)}, [{', '.join(repr(c) for c in strict)}])"] if strict else []
    return "(" + " OR ".join(parts + [f"contains(lower({x}), '{c}')" for c in loose]) + ")"


def _sql_count(x: str, cues: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{c}')::INT" for c in cues) + ")"


def sql_injection_risk(x: str) -> str:
    lower, compact = f"lower({x})", f"regexp_replace(lower({x}), '[^a-z0-9㐀-鿿]+', '', 'g')"
    return (
        f"least(1.0e0, 0.58e0 * ({_sql_count(lower, INJECTION_CUES)} + {_sql_count(compact, INJECTION_COMPACT)}) + 0.16e0 * {_sql_count(compact, OBFUSCATED)}"
        f" + 0.10e0 * {_sql_count(lower, COMMAND_CUES)} + 0.14e0 * {_sql_count(lower, SECRET_CUES)})"
    )


def sql_memory_kind(x: str, requested: str) -> str:
    event = " OR ".join(f"contains(lower({x}), '{c}')" for c in EVENT_CUES)
    return (
        f"CASE WHEN {requested} <> '' THEN {requested} WHEN {sql_has_cue(x, PREFERENCE_CUES)} THEN 'preference' WHEN {sql_has_cue(x, FUTURE_CUES)} THEN 'instruction' "
        f"WHEN {event} THEN 'event' ELSE 'fact' END"
    )


def sql_text_entities(x: str, supplied: str | None = None) -> str:
    parts = f"list_concat(list_transform(list_filter(string_split_regex({x}, '{_WORD_SPLIT}'), lambda w: regexp_matches(w, '{CAPITALIZED}')), lambda w: lower(w)), regexp_extract_all({x}, '[㐀-鿿]{{2,8}}'))"
    if supplied:
        parts = f"list_concat({parts}, list_filter(list_transform(coalesce({supplied}, []), lambda s: lower(trim(s))), lambda s: s IS NOT NULL AND s <> ''))"
    return f"list_sort(list_distinct({parts}))[1:24]"


def sql_value_items(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({x}, '{_ITEM_SPLIT}'), lambda w: regexp_matches(w, '{VALUE_ITEM}')))"
