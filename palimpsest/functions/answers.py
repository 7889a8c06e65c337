"""Forms of texts and answers: normal forms, answer leaves, facts inferred from a sentence, dates, sizes, judgements."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as T

# Words of time, patterns of capitalized names and of years and dates, first words of a correction.
TIME_WORDS = "today yesterday tomorrow before after first last next".split()
TIME_WORDS_ZH = "今天 昨天 明天 之前 之后 首次 最后 下次".split()
GOAL_NAME = r"(?<![\p{L}\p{N}_])[A-Z][A-Za-z0-9_.-]*[A-Za-z0-9_](?![\p{L}\p{N}_])|[一-鿿]{2,8}"
YEAR_OR_DATE = "(?:19|20)[0-9]{2}(?:[-/][0-9]{1,2}(?:[-/][0-9]{1,2})?)?"
CORRECTION_WORDS = "correction|actually|update|更正|更新|其实"
# Verbs that part a sentence into subject, predicate and object.
VERBS = ["uses", "prefers", "likes", "dislikes", "has", "is", "requires", "runs on", "changed to"]
VERBS_ZH = "使用 偏好 喜欢 讨厌 拥有 是 需要 改为".split()
TRIVIAL_ANSWERS = frozenset("none true false days day".split())


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalized_text(text: Column | str) -> Column:
    """Memory tokens joined by blanks."""
    return F.array_join(T.memory_tokens(text), " ")


def ascii_words(text: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def word_form(text: Column | str) -> Column:
    """Lower-case runs of letters, marks, digits and underscores joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{M}\p{N}_]+", " "))


def normal_form(value: str | None) -> str | None:
    """Compatibility form, case folded, words joined by blanks; null stays null."""
    if value is None:
        return None
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", value).casefold()))


def normal_form_udf(col: Column) -> Column:
    """normal_form of a column: ASCII texts stay in the JVM, others go through Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(normal_form, na_action="ignore")

    plain = F.length(col) == F.octet_length(col)
    ascii_form = F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9_]+", " "))
    return F.coalesce(F.when(plain, ascii_form), F.pandas_udf(run, "string")(F.when(~plain, col)))


def answer_leaves(value) -> list[str]:
    """Normal forms of all leaves of a nested answer, two characters or more, longest first, then by text."""
    found: set[str] = set()
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, (list, tuple, set)):
            stack.extend(x)
        elif x is not None:
            found.add(normal_form(str(x)) or "")
    return sorted((x for x in found if len(x) >= 2), key=lambda x: (-len(x), x))


def answer_leaves_udf(col: Column) -> Column:
    """answer_leaves of JSON texts; what is no JSON is one leaf; null has none."""

    def parse(text):
        if text is None:
            return []
        try:
            return answer_leaves(json.loads(text))
        except ValueError:
            return answer_leaves(text)

    return F.pandas_udf(lambda s: s.map(parse), "array<string>")(col)


def answer_components(col: Column) -> Column:
    """The leaves on which another answer can depend: four characters or more, no trivial words."""
    return F.filter(col, lambda x: (F.length(x) >= 4) & ~x.isin(*sorted(TRIVIAL_ANSWERS)))


def answer_pieces(text: Column | str) -> Column:
    """Word forms of the parts of an answer between commas and semicolons, two characters or more."""
    return F.filter(F.transform(F.split(_c(text), "[;,]"), word_form), lambda x: F.length(x) >= 2)


def trigrams(text: Column | str) -> Column:
    """Distinct character trigrams of the normalized text between two blanks on either side."""
    padded = F.concat(F.lit("  "), normalized_text(text), F.lit("  "))
    return F.array_distinct(F.element_at(F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - 2)), lambda i: F.substr(p, i, F.lit(3)))), 1))


def goal_names(text: Column | str) -> Column:
    """Capitalized names and Chinese runs, lower-case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(GOAL_NAME), F.lit(0)), lambda w: F.lower(w)))


def time_keys(text: Column | str, created: Column | None = None) -> Column:
    """Years, dates and words of time in a text, with the month the row was made in."""
    low = F.lower(_c(text))
    found = F.concat(
        F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9_])(?:{YEAR_OR_DATE})(?![a-z0-9_])"), F.lit(0)),
        F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9_])(?:{'|'.join(TIME_WORDS)})(?![a-z0-9_])"), F.lit(0)),
        F.regexp_extract_all(low, F.lit("|".join(TIME_WORDS_ZH)), F.lit(0)),
    )
    if created is not None:
        found = F.concat(found, F.filter(F.array(F.date_format(created, "yyyy-MM")), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(found))


def parsed_date(text: Column | str) -> Column:
    """The first date of the form 20yy-m-d or 20yy/m/d; a date that does not exist is null."""
    part = lambda i: F.regexp_extract(_c(text), "(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", i)
    joined = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.to_date(F.try_to_timestamp(joined, F.lit("yyyy-MM-dd")))


def approx_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(_c(text)) / 4)).cast("int")


def inferred_fact(text: Column | str, entities: Column, subject: Column | None = None, predicate: Column | None = None, value: Column | None = None) -> Column:
    """struct(subject, predicate, object_value, polarity) of a sentence; given parts win, the first entity stands in for a subject.

    Only the first verb parts the sentence, in the order of its words. A negation anywhere in the text, even inside a
    longer word, makes the polarity -1.
    """
    t = _c(text)
    clean = F.regexp_replace(F.regexp_replace(F.trim(t), f"(?i)^(?:{CORRECTION_WORDS})\\s*[:：]?\\s*", ""), "[。.!！]+$", "")
    english = f"(?is)^(.+?)\\s+({'|'.join(VERBS)})\\s+(.+)$"
    chinese = f"(?is)^([㐀-鿿A-Za-z0-9 _-]{{1,40}}?)({'|'.join(VERBS_ZH)})(.+)$"
    hit = F.rlike(clean, F.lit(english))
    # sentence letters only in one line, as a dot ends at a line break
    part = lambda i: F.nullif(F.trim(F.when(hit, F.regexp_extract(clean, english, i)).otherwise(F.regexp_extract(clean, chinese, i))), F.lit(""))
    nothing = F.lit(None).cast("string")
    given = [x if x is not None else nothing for x in (subject, predicate, value)]
    first = F.element_at(F.array_sort(entities), 1)
    negative = F.lit(False)
    for cue in T.NEGATIONS:
        negative = negative | F.contains(F.lower(t), F.lit(cue))
    return F.struct(
        F.coalesce(given[0], part(1), F.when(F.size(entities) > 0, first)).alias("subject"), F.coalesce(given[1], F.lower(part(2))).alias("predicate"), F.coalesce(given[2], part(3)).alias("object_value"),
        F.when(negative, -1).otherwise(1).alias("polarity"),
    )


def inferred_key(text: Column | str, entities: Column, fact: Column, supplied: Column | None = None) -> Column:
    """Key of a fact: the supplied one, subject and predicate, or the first entity or token with the next plain token."""
    tok = T.memory_tokens(text)
    subject = F.when(F.size(entities) > 0, F.element_at(F.array_sort(entities), 1)).otherwise(F.element_at(tok, 1))
    rest = F.filter(F.slice(tok, 2, 1000), lambda w: ~w.isin(T.NEGATIONS))
    guessed = F.when(F.size(tok) > 0, F.concat(subject, F.lit(":"), F.when(F.size(rest) > 0, F.element_at(rest, 1)).otherwise("state")))
    told = F.when(fact["subject"].isNotNull() & fact["predicate"].isNotNull(), F.concat(normalized_text(fact["subject"]), F.lit(":"), normalized_text(fact["predicate"])))
    own = F.when(supplied != "", normalized_text(supplied)) if supplied is not None else F.lit(None).cast("string")
    return F.coalesce(own, told, guessed)


def judgement(raw: Column | str) -> Column:
    """CORRECT, WRONG or PARSE_ERROR: the label of a JSON answer, else the last such word of the text."""
    t = _c(raw)
    label = F.upper(F.trim(F.get_json_object(t, "$.label")))
    words = F.regexp_extract_all(F.upper(t), F.lit("(?<![A-Z0-9_])(?:CORRECT|WRONG)(?![A-Z0-9_])"), F.lit(0))
    told = F.when(F.try_parse_json(t).isNotNull(), label).otherwise(F.when(F.size(words) > 0, F.element_at(words, -1)))
    return F.when(told.isin("CORRECT", "WRONG"), told).otherwise("PARSE_ERROR")


def dialogue_ids(text: Column | str) -> Column:
    """Dialogue ids such as D9:1 in a text; a text without any is an id itself."""
    ids = F.regexp_extract_all(_c(text), F.lit("D[0-9]+:[0-9]+"), F.lit(0))
    whole = F.trim(_c(text))
    return F.array_sort(F.array_distinct(F.when(F.size(ids) > 0, ids).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))))


def leaf_strings(json_text: Column | str) -> Column:
    """All scalar leaves of a JSON text as strings, each once; nested lists and objects are walked to any depth."""

    def leaves(text):
        if text is None:
            return []
        try:
            stack, out = [json.loads(text)], set()
        except ValueError:
            return [text]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                stack.extend(x.values())
            elif isinstance(x, list):
                stack.extend(x)
            elif x is not None:
                out.add(str(x))
        return sorted(out)

    return F.pandas_udf(lambda s: s.map(leaves), "array<string>")(_c(json_text))
