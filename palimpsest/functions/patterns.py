"""Word lists as one pattern over lower-case text, read alike by Java and by RE2.

A list is text: entries between commas. Latin entries are whole words or phrases; an entry with a star at its end is the
beginning of a word; ``..`` stands for anything between; words in braces are alternatives, {a b} c is a c and b c. Entries
in Chinese stand anywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(text: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def _body(item: str) -> str:
    """Pattern of one entry without its outer boundaries."""
    out = []
    for part in item.split(".."):
        pieces = re.split(r"\{([^}]*)\}", part.strip() if ".." in item else part)
        out.append("".join(_plain(x) if i % 2 == 0 else "(?:" + "|".join(map(_plain, x.split())) + ")" for i, x in enumerate(pieces)))
    first, *rest = out
    for x in rest:
        first += (r"\b" if first else "") + ".*" + (r"\b" + x if x else "")
    return first


def pattern(words: str) -> str:
    whole, begin, anywhere = [], [], []
    for item in words.replace("\n", " ").split(","):
        item = " ".join(item.split()) if not item.rstrip().endswith(" *") else " ".join(item.split())[:-1] + "*"
        if not item:
            continue
        starred = "*" in item
        body = _body(item.replace("*", ""))
        (anywhere if re.search("[\u4e00-\u9fff]", item) else begin if starred else whole).append(body)
    out = [rf"\b(?:{'|'.join(whole)})\b"] if whole else []
    return "|".join(out + ([rf"\b(?:{'|'.join(begin)})"] if begin else []) + anywhere)


def says(text: Column | str, words: str) -> Column:
    return F.rlike(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(pattern(words)))


def sql_says(text: str, words: str) -> str:
    p = pattern(words).replace("'", "''")
    return f"regexp_matches(lower({text}), '{p}')"
