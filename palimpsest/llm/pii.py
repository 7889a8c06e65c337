"""Personal data in free text, by a semi-Markov conditional random field.

The lattice holds the spans of a bounded number of tokens that could be an e-mail address, phone number, identity number,
street address or personal name. They get whole-span features: their shape, their words, and the words around them. The
field scores every set of segments that do not overlap; bounded-entity dynamic programming finds the best one and thereby
boundaries and types together. Weights are trained here, by maximum conditional likelihood on generated sentences (pii_training).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canonical import LOOKALIKES
from palimpsest.llm.lexicon import GIVEN_NAMES, HAN_COMPOUND, HAN_SURNAMES, LEGAL_FORMS, NOT_NAMES, OTHER_GIVEN, RUSSIAN_GIVEN, TECHNICAL, TITLES

TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")


class Segment(NamedTuple):
    start: int
    end: int
    kind: str


# --- a plain view of the text, with the way back to stored characters -----------------------------------------------

_ODD = re.compile("[ ­̀-Ͽа-֏ЅІЈА-Я  -― -  ⁠　ﬀ-ﬆ︀-️﻿！-～]")


_OWN_CYRILLIC = re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]")
_CYRILLIC_WORD, _LATIN = re.compile(r"\w*[Ѐ-ԯ]\w*"), re.compile("[A-Za-z]")


@lru_cache(1)
def _plain_chars() -> dict[str, str]:
    table = {b: a for latin, other in LOOKALIKES.values() for a, b in zip(latin, other)}
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c) not in "，：；！？（）"}
    table |= {"（": "(", "）": ")", "‐": "-", "‑": "-"}
    return table


def plain_view(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes, blanks and full-width forms made plain and invisible characters left out.

    Also the position in the text of each character of the view, or None where both are the same.
    """
    if text.isascii() or not _ODD.search(text):
        return text, None
    out, at, table = [], [], _plain_chars()
    if _OWN_CYRILLIC.search(text):  # Russian stays Russian; only words that mix scripts are made plain
        keep = {i for m in _CYRILLIC_WORD.finditer(text) if not _LATIN.search(m.group()) for i in range(*m.span())}
    else:
        keep = frozenset()
    for i, ch in enumerate(text):
        if i in keep:
            out.append(ch)
            at.append(i)
            continue
        cat = unicodedata.category(ch)
        if cat in ("Cf", "Mn"):
            continue
        plain = " " if cat == "Zs" else table.get(ch) or (unicodedata.normalize("NFKC", ch) if "ﬀ" <= ch <= "ﬆ" else ch)
        out.append(plain)
        at += [i] * len(plain)
    at.append(len(text))
    return "".join(out), at


# --- tokens and the lattice of bounded spans --------------------------------------------------------------------------

# Words for streets, before or after their names, and for parts of a building.
STREET_AFTER = "Street St Road Rd Lane Ln Way Terrace Avenue Ave Court Ct Close Drive Dr Place Pl Row Gardens Crescent Square Boulevard Blvd Hill Walk Mews Parkway Highway".split()
STREET_BEFORE = "rue avenue boulevard place impasse chemin allée quai Calle Avenida Paseo Plaza Camino Via Viale Piazza Rua улица ул проспект".split()
STREET_JOINED = "straße strasse weg gasse platz allee ufer damm ring".split()
UNITS = "Flat Apt Apartment Unit Suite Room Floor No".split()
# Small words inside family names and street names.
PARTICLES = frozenset("de la las los del der den van von zu zum zur da das do dos du des di della le el al bin ibn ben ter ten y e".split())
# Endings of Russian family names (with their cases).
RUSSIAN_ENDINGS = tuple("ов ова ову овым овой ове ев ева еву евым евой еве ин ина ину иным иной ёв ёва ский ская скому ского ской ским енко чук ук".split())

_L = "A-Za-zÀ-ÖØ-öø-ɏЀ-ԯ"
_TOKEN = re.compile(rf"[{_L}]+(?:['’](?![sS](?![{_L}]))[{_L}]+|-[{_L}]{{2,}})*|\d+|[^\s]")
_MAYBE_MAIL = re.compile(r"@|[(\[{<] ?at ?[)\]}>]|\bdot\b", re.I)
_OPEN, _CLOSE = "([{<", ")]}>"
_STREET_WORDS = frozenset((*STREET_AFTER, *STREET_BEFORE))
_UNIT_WORDS = frozenset(UNITS)
#: Most tokens of a segment of each type: the segments of a text are bounded spans, whatever stands in them.
MOST = {"NAME": 9, "PHONE": 16, "ID": 9, "ADDRESS": 14, "EMAIL": 24}


class Tokens(NamedTuple):
    """Tokens of a text: words (with inner hyphens), digit runs and single other characters.

    kind: C capitalized word, I single capital, l other word, H Chinese character, d digits, else the character.
    """

    text: str
    word: list[str]
    start: list[int]
    end: list[int]
    kind: list[str]


def tokens(text: str) -> Tokens:
    word, start, end, kind = [], [], [], []
    for m in _TOKEN.finditer(text):
        w = m.group()
        c = w[0]
        if c.isdigit():
            k = "d"
        elif c.isalpha():
            if "一" <= c <= "鿿":
                k = "H"
            elif c.isupper():
                k = "C" if len(w) > 1 else "I"
            else:
                k = "l"
        else:
            k = c
        word.append(w)
        start.append(m.start())
        end.append(m.end())
        kind.append(k)
    return Tokens(text, word, start, end, kind)


def _gap(t: Tokens, i: int) -> bool:
    """Whether token i follows token i - 1 on the same line (side by side or after blanks)."""
    a, b = t.end[i - 1], t.start[i]
    return a == b or t.text[a:b].isspace() and "\n" not in t.text[a:b]


def _open_before(t: Tokens, i: int, glue: str) -> bool:
    """Whether a segment may begin at token i: nothing of a longer word or number touches it."""
    if i == 0 or t.end[i - 1] != t.start[i]:
        return True
    k = t.kind[i - 1]
    return k not in "CIld" and k not in glue


def _open_after(t: Tokens, j: int, glue: str) -> bool:
    """Whether a segment may end before token j."""
    if j >= len(t.word) or t.start[j] != t.end[j - 1]:
        return True
    k = t.kind[j]
    if k in "CIld" or k in glue:
        return False
    return not (k in ".,:" and j + 1 < len(t.word) and t.start[j + 1] == t.end[j] and t.kind[j + 1] == "d" and t.kind[j - 1] == "d")


def _name_spans(t: Tokens, i: int, n: int) -> Iterator[int]:
    k = t.kind
    if k[i] == "H":
        if t.word[i] in HAN_SURNAMES or (i + 1 < n and t.word[i] + t.word[i + 1] in HAN_COMPOUND):
            for size in (2, 3, 4) if i + 1 < n and t.word[i] + t.word[i + 1] in HAN_COMPOUND else (2, 3):
                if i + size <= n and all(k[x] == "H" and (x == i or t.start[x] == t.end[x - 1]) for x in range(i, i + size)):
                    yield i + size
        return
    if not _open_before(t, i, "@_/\\#&.-"):
        return
    parts = words = 0
    comma = False
    j, top = i, min(n, i + MOST["NAME"])
    while j < top:
        if j > i and not _gap(t, j):
            return
        kj = k[j]
        if kj == "C" or kj == "I":
            parts += 1
            words += kj == "C"
            j += 1
            if kj == "I" and j < n and k[j] == "." and t.start[j] == t.end[j - 1]:
                j += 1
            if parts > 1 and words and _open_after(t, j, "@_&"):
                yield j
            if parts == 5:
                return
        elif kj == "l" and t.word[j] in PARTICLES:
            j += 1
        elif kj == "," and parts and not comma and t.start[j] == t.end[j - 1]:
            comma = True
            j += 1
        else:
            return


def _number_spans(t: Tokens, i: int, n: int) -> Iterator[tuple[int, str]]:
    """Ends of phone and identity numbers that begin at token i."""
    k = t.kind
    head = k[i]
    phone = head in "+(d"
    ident = head == "d" or head in "CI" and len(t.word[i]) <= 3 and t.word[i].isupper()
    if not _open_before(t, i, "+._/\\#-@" if head != "(" else "_"):
        return
    digits = letters = depth = last = 0
    j, top = i, min(n, i + MOST["PHONE"])
    while j < top and (phone or ident):
        if j > i and (not _gap(t, j) or t.start[j] - t.end[j - 1] > 1):
            return
        kj = k[j]
        if kj == "d":
            digits += len(t.word[j])
            last = j + 1
        elif kj in "CI" and len(t.word[j]) <= 3 and t.word[j].isupper():
            letters += len(t.word[j])
            phone = False
            last = j + 1
        elif kj == "(":
            depth += 1
            ident = False
        elif kj == ")":
            depth -= 1
            ident = False
        elif kj in "./-":
            if t.start[j] != t.end[j - 1] or j + 1 >= n or t.start[j + 1] != t.end[j]:
                return  # a separator stands between two parts
        elif kj == "+" and j == i:
            ident = False
        else:
            return
        j += 1
        if digits > 18 or depth < 0 or letters > 4:
            return
        ident = ident and j - i <= MOST["ID"]
        phone = phone and digits <= 15
        if last == j and _open_after(t, j, "_/-@") and not depth:
            if phone and 7 <= digits:
                yield j, "PHONE"
            if ident and digits >= 5 and 6 <= digits + letters <= 18:
                yield j, "ID"


def _address_spans(t: Tokens, i: int, n: int) -> Iterator[int]:
    k = t.kind
    if not (k[i] == "C" or k[i] == "d" and len(t.word[i]) <= 5 or k[i] == "l" and t.word[i] in _STREET_WORDS) or not _open_before(t, i, "+._/\\#-@"):
        return
    number = words = 0
    j, top = i, min(n, i + MOST["ADDRESS"])
    while j < top:
        if j > i and not _gap(t, j):
            return
        kj, w = k[j], t.word[j]
        if kj == "d":
            if len(w) > 5 or not number and j > i and t.start[j] == t.end[j - 1] and k[j - 1] not in "#-":
                return
            number += 1
            j += 1
            if j < n and t.start[j] == t.end[j - 1] and k[j] in "Il" and len(t.word[j]) == 1:
                j += 1  # 12a
        elif kj == "C" or kj == "I" and j > i:
            words += kj == "C"
            j += 1
            if j < n and k[j] == "." and t.start[j] == t.end[j - 1] and len(w) <= 4:
                # St. and No. keep their dot inside; a span may also end before it
                if number and words and kj == "C":
                    yield j
                j += 1
                continue
        elif kj == "l" and (w in PARTICLES or w in _STREET_WORDS or w == "d" or w.startswith(("d'", "l'"))) or kj in ",#" and j > i or kj in "'-" and j > i and t.start[j] == t.end[j - 1]:
            j += 1
            continue
        else:
            return
        if number and words and _open_after(t, j, "_/@-"):
            yield j


def _han_address_spans(t: Tokens, i: int, n: int) -> Iterator[tuple[int, int]]:
    """Spans around a number that is followed by the sign for a house number: up to eight characters before it."""
    if t.kind[i] != "d" or i + 1 >= n or t.word[i + 1] not in "号弄":
        return
    e = i + 2
    while e < n and (t.kind[e] == "d" or t.word[e] in "室楼栋单元层号") and t.start[e] == t.end[e - 1]:
        e += 1
    for s in range(i - 1, max(-1, i - 9), -1):
        if t.kind[s] != "H" or t.end[s] != t.start[s + 1]:
            return
        if i - s >= 2:
            yield s, e


def _mail_spans(t: Tokens, a: int, n: int) -> Iterator[tuple[int, int]]:
    """Spans of an e-mail address around the sign or word for 'at' at token a."""
    k, w = t.kind, t.word
    s0, e0 = a, a + 1
    if s0 and e0 < n and k[s0 - 1] in _OPEN and k[e0] in _CLOSE:
        s0, e0 = s0 - 1, e0 + 1
    bare = s0 == a and k[a] != "@"

    def joint(x: int, step: int) -> int:
        """Tokens of a disguised or plain joint of two labels at x, walking by step."""
        if not 0 <= x < n:
            return 0
        if w[x] == "." or k[x] in "_%+-":
            return 1
        if w[x].lower() == "dot":
            return 1
        y = x + 2 * step
        return 3 if 0 <= y < n and w[x + step].lower() == "dot" and k[x] in _OPEN + _CLOSE and k[y] in _OPEN + _CLOSE else 0

    starts, x = [], s0 - 1
    while x >= 0 and len(starts) < 6 and s0 - x < 14:
        if k[x] not in "CIld":
            break
        while x and k[x - 1] in "CIld" and t.end[x - 1] == t.start[x]:
            x -= 1
        starts.append(x)
        size = joint(x - 1, -1)
        if not size or k[x - 1] in "._%+-" and t.end[x - 1] != t.start[x]:
            break
        if k[x - 1] in "._%+-" and x >= 2 and k[x - 2] in "._%+-":
            break
        x -= 1 + size
    # a start inside a run of glued labels is none
    starts = [x for x in starts if _open_before(t, x, "._%+-@")]
    ends, y, dots = [], e0, 0
    while y < n and len(ends) < 6 and y - e0 < 14:
        if k[y] not in "CIld":
            break
        while y + 1 < n and k[y + 1] in "CIld" and t.start[y + 1] == t.end[y]:
            y += 1
        y += 1
        if dots:
            ends.append(y)
        size = joint(y, 1)
        if not size or w[y] == "." and (t.start[y] != t.end[y - 1] or y + 1 >= n or t.start[y + 1] != t.end[y]):
            break
        dots += k[y] not in "_%+-"
        y += size
    ends = [y for y in ends if _open_after(t, y, "_@")]
    for s in starts:
        for e in ends:
            if not bare or any(w[x].lower() == "dot" for x in range(a, e)):
                yield s, e


class Span(NamedTuple):
    """Tokens first to last (excluded) as a segment of a type."""

    first: int
    last: int
    kind: str


def lattice(t: Tokens) -> list[Span]:
    """All bounded spans of a plain view that could be personal data.

    A span is left out only for what no item of its type can be: a name without a capital, a number without digits, an
    address without number or name, a mail address without 'at' and 'dot'. Order, shape and wording are left to the field.
    """
    n, out = len(t.word), []
    mail = _MAYBE_MAIL.search(t.text) is not None
    for i, k in enumerate(t.kind):
        if k == "C":
            out += [Span(i, j, "NAME") for j in _name_spans(t, i, n)]
            out += [Span(i, j, "ADDRESS") for j in _address_spans(t, i, n)]
            if len(t.word[i]) <= 3:
                out += [Span(i, j, kind) for j, kind in _number_spans(t, i, n)]
        elif k == "I":
            out += [Span(i, j, "NAME") for j in _name_spans(t, i, n)]
            out += [Span(i, j, kind) for j, kind in _number_spans(t, i, n)]
        elif k == "d":
            out += [Span(i, j, kind) for j, kind in _number_spans(t, i, n)]
            out += [Span(i, j, "ADDRESS") for j in _address_spans(t, i, n)]
            out += [Span(s, e, "ADDRESS") for s, e in _han_address_spans(t, i, n)]
        elif k in "+(":
            out += [Span(i, j, kind) for j, kind in _number_spans(t, i, n)]
        elif k == "H":
            out += [Span(i, j, "NAME") for j in _name_spans(t, i, n)]
        elif k == "l" and t.word[i] in PARTICLES:
            out += [Span(i, j, "NAME") for j in _name_spans(t, i, n)]
        elif k == "l" and t.word[i] in _STREET_WORDS:
            out += [Span(i, j, "ADDRESS") for j in _address_spans(t, i, n)]
        if mail and (k == "@" or t.word[i].lower() == "at"):
            out += [Span(s, e, "EMAIL") for s, e in _mail_spans(t, i, n)]
    return out


# --- whole-span features ---------------------------------------------------------------------------------------------


@lru_cache(100_000)
def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)) if not word.isascii() else word.lower()


@lru_cache(1)
def _given() -> frozenset[str]:
    return frozenset(x for k, v in GIVEN_NAMES.items() for x in (k, *v.split())) | OTHER_GIVEN | RUSSIAN_GIVEN


@lru_cache(100_000)
def _known(part: str) -> str:
    """1 for a given name, s for the ending of a Russian family name, 0 for other words."""
    given = _given()
    p = _fold(part)
    if p in given or "-" in p and p.split("-")[0] in given or p[-1:] in "уае" and (p[:-1] in given or p[:-1] + "а" in given) and "Ѐ" <= p[0]:
        return "1"
    return "s" if "Ѐ" <= p[0] and p.endswith(RUSSIAN_ENDINGS) else "0"


@lru_cache(100_000)
def _shape(span: str) -> str:
    return re.sub(r"\d+", lambda m: str(len(m.group())), re.sub("[A-Z]", "A", span))


def _is_title(t: Tokens, i: int) -> bool:
    return i >= 0 and (t.word[i].lower() in TITLES or t.word[i] == "." and i > 0 and t.word[i - 1].lower() in TITLES)


def features(t: Tokens, s: Span) -> list[str]:
    """Features of a whole segment under its type: its words, shape and bounds, and the words around it."""
    i, j = s.first, s.last
    k = s.kind[0]
    word, n = t.word, len(t.word)
    out = [k]
    l1 = word[i - 1].lower() if i else "^"
    r1 = word[j].lower() if j < n else "$"
    out.append(f"{k}<{l1}")
    out.append(f"{k}>{r1}")
    for x in range(max(0, i - 4), i):
        if t.kind[x] in "lCI" or t.kind[x] == "H":
            out.append(f"{k}l{word[x].lower()}")
    if i > 1:
        out.append(f"{k}2{word[i - 2].lower()}_{l1}")
    for x in range(j, min(n, j + 2)):
        if t.kind[x] in "lCIH":
            out.append(f"{k}r{word[x].lower()}")
    if k == "N":
        if t.kind[i] == "H":
            alone = (i == 0 or t.kind[i - 1] != "H") + 2 * (j == n or t.kind[j] != "H")
            out += ["NH", f"NHa{alone}", f"NHn{j - i}|{alone}", f"NH<{l1}", f"NHc{word[i]}", f"NHe{word[j - 1]}", f"NH>{r1}"]
            if i > 1:
                out.append(f"NH2{word[i - 2]}{l1}")
            return out
        parts = [x for x in range(i, j) if t.kind[x] in "CI"]
        comma = any(word[x] == "," for x in range(i, j))
        known = "".join(_known(word[x]) for x in (parts[0], parts[-1]))
        form = "".join("i" if t.kind[x] == "I" else "w" for x in parts)
        order = "c" if comma else "n"
        small = any(t.kind[x] == "l" for x in range(i, j))
        out += [f"N{order}{known}", f"N{order}{form}", f"N{order}{known}{form}", f"N{order}{known}{form}{small}"]
        if len(parts) > 2:
            out.append(f"N{order}m" + "".join(_known(word[x]) for x in parts))
        first, last = _fold(word[parts[0]]), _fold(word[parts[-1]])
        if i == 0 or t.kind[i - 1] in ".!?:;" or t.text[t.end[i - 1]] == "\n":
            out.append(f"N^{order}{known}{form}")
        if "1" not in known:
            out += [f"Nw{first}", f"Nw{last}"]
        if _is_title(t, i - 1):
            out.append("Nt")
        if r1 in LEGAL_FORMS or last in LEGAL_FORMS:
            out.append("Ng")
        if first in TITLES:
            out.append("Nti")
        if first in NOT_NAMES:
            out.append("Nnf")
        if last in NOT_NAMES or any(_fold(word[x]) in NOT_NAMES for x in parts[1:-1]):
            out.append("Nnl")
        if word[parts[-1]] in _STREET_WORDS and j - i > 1:
            out.append("Nst")
        if j < n and t.kind[j] in "CI" and t.start[j] - t.end[j - 1] == 1:
            out.append(f"Nc>{_known(word[j])}{order}")
        if i and t.kind[i - 1] in "CI" and t.start[i] - t.end[i - 1] == 1:
            out.append(f"Nc<{_known(word[i - 1])}{order}")
        if j < n and t.kind[j] == "d" or j + 1 < n and r1 == "-" and t.kind[j + 1] == "d":
            out.append("Nd")
        upper = [word[x].isupper() for x in parts if t.kind[x] == "C"]
        if any(upper) and not all(upper):
            out.append("Nmix")
        for x in parts:
            if t.kind[x] == "I" and (x + 1 >= n or word[x + 1] != "."):
                out.append(f"Nb{word[x]}{known}")
        return out
    span = t.text[t.start[i] : t.end[j - 1]]
    if k in "PI":
        shape = _shape(span)
        digits = sum(c.isdigit() for c in span)
        seps = "".join(sorted({c for c in span if not c.isalnum()}))
        out += [f"{k}s{shape}", f"{k}d{digits}", f"{k}p{seps}", f"{k}d{digits}{seps}", f"{k}h{span[0] if not span[0].isdigit() else '0' if span[0] == '0' else 'd'}"]
        if any(word[x].lower() in TECHNICAL for x in range(max(0, i - 3), i)):
            out += [f"{k}tech", f"{k}tech{shape}"]
        if "A" in shape:
            out.append(f"{k}a{shape.count('A')}")
        if i and t.kind[i - 1] in "d+)" and t.start[i] - t.end[i - 1] <= 1:
            out.append(f"{k}cut<")
        if j < n and t.kind[j] in "d(" and t.start[j] - t.end[j - 1] <= 1:
            out.append(f"{k}cut>")
    elif k == "E":
        low = span.lower()
        plain = "@" in span
        out += [f"Eat{plain}", f"Edot{plain}{' dot ' in low or '(dot' in low or '[dot' in low}", f"Eend{low.rsplit('.', 1)[-1].rsplit(' ', 1)[-1][:6]}", f"Ebl{plain}{min(6, span.count(' '))}"]
        if i > 1 and word[i - 1].lower() == "dot":
            out.append("Emore<")
        if j < n and (word[j].lower() == "dot" or word[j] in "([{" and j + 1 < n and word[j + 1].lower() == "dot" or word[j] == "." and j + 1 < n and t.start[j + 1] == t.end[j]):
            out.append("Emore>")
        if t.kind[i] == "l" and word[i] in ("me", "us", "him", "her", "them", "it", "mail", "email", "write", "contact", "is"):
            out.append("Esmall")
    else:
        inside = word[i:j]
        street = [w for w in inside if w in _STREET_WORDS]
        joined = any(w.lower().endswith(tuple(STREET_JOINED)) and len(w) > 6 for w in inside)
        unit = sum(w in _UNIT_WORDS for w in inside)
        numbers = sum(t.kind[x] == "d" for x in range(i, j))
        head = "d" if t.kind[i] == "d" else "u" if word[i] in _UNIT_WORDS else "s" if word[i] in STREET_BEFORE else "j" if joined and word[i].lower().endswith(tuple(STREET_JOINED)) else "H" if t.kind[i] == "H" else "w"
        tail = "d" if t.kind[j - 1] == "d" or j > 1 and t.kind[j - 2] == "d" and t.start[j - 1] == t.end[j - 2] else "s" if word[j - 1] in _STREET_WORDS else "w"
        kind = "b" if any(w in STREET_BEFORE for w in street) else "a" if street else "j" if joined else "h" if t.kind[i] == "H" else "n"
        out += [f"A{kind}", f"A{kind}{head}{tail}", f"Au{kind}{head}{tail}{min(2, unit)}{min(3, numbers)}", f"An{kind}{min(3, numbers)}", f"Ac{kind}{inside.count(',')}", f"Aw{min(9, j - i)}{kind}"]
        if j < n and (word[j] in _UNIT_WORDS or word[j] == "," and j + 1 < n and word[j + 1] in _UNIT_WORDS):
            out.append("Amore>")
        if j < n and word[j] in _STREET_WORDS:
            out.append("Ast>")
        if i and (t.kind[i - 1] == "d" or word[i - 1] in _UNIT_WORDS) and t.start[i] - t.end[i - 1] <= 1:
            out.append("Amore<")
        if i > 2 and word[i - 1] == "," and t.kind[i - 2] == "d" and word[i - 3] in _UNIT_WORDS:
            out.append("Aunit<")
        if any(word[x] in _UNIT_WORDS and (x + 1 >= j or t.kind[x + 1] not in "d#.") for x in range(i, j)):
            out.append("Aopen")
        if head == "H":
            out += [f"AH{word[i]}", f"AH<{l1}", f"AHs{inside[-3] if len(inside) > 2 else ''}"]
            if any(w in "路街道巷弄" for w in inside):
                out.append("AHstreet")
    return out


# --- the field --------------------------------------------------------------------------------------------------------


def best_segments(segs: list[Segment], scores: list[float]) -> list[Segment]:
    """The set of segments without overlap of the greatest total score; outside a segment the score is 0."""
    order = sorted(range(len(segs)), key=lambda i: (segs[i].end, segs[i].start))
    ends = [segs[i].end for i in order]
    best, take = [0.0], []
    for n, i in enumerate(order):
        before = bisect_right(ends, segs[i].start, 0, n)
        with_it = best[before] + scores[i]
        take.append((with_it > best[n], before))
        best.append(max(best[n], with_it))
    out, n = [], len(order)
    while n:
        used, before = take[n - 1]
        if used:
            out.append(segs[order[n - 1]])
        n = before if used else n - 1
    return out[::-1]


def find_segments(text: str, weights: dict[str, float]) -> list[tuple[str, str, int, int]]:
    """(type, stored characters, start, end) of the personal data in a text, in order."""
    view, at = plain_view(text)
    t = tokens(view)
    spans = lattice(t)
    if not spans:
        return []
    get = weights.get
    scored = [(s, v) for s in spans if (v := sum([get(f, 0.0) for f in features(t, s)])) > 0]
    if not scored:
        return []
    found = best_segments([Segment(t.start[s.first], t.end[s.last - 1], s.kind) for s, _ in scored], [v for _, v in scored])
    if at is None:
        return [(s.kind, text[s.start : s.end], s.start, s.end) for s in found]
    # a segment ends after its last character, marks that belong to it included
    out = []
    for s in found:
        a, b = at[s.start], at[s.end - 1] + 1
        while b < len(text) and unicodedata.category(text[b]) == "Mn":
            b += 1
        out.append((s.kind, text[a:b], a, b))
    return out


def redact_text(text: str, weights: dict[str, float]) -> str:
    """The text with each item replaced by [TYPE]; all else stays as stored."""
    out, last = [], 0
    for kind, _, a, b in find_segments(text, weights):
        out += [text[last:a], f"[{kind}]"]
        last = b
    return "".join(out) + text[last:]


def pii_items(df: DataFrame, keep: list[str], text: str, weights: dict[str, float]) -> DataFrame:
    """(keep columns, pii_type, pii_text): one row per different item of a text.

    Null and empty texts have none; the whole of a text is searched, whatever its length. Repeated rows give repeated
    items only once per row kept.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([list(dict.fromkeys(x[:2] for x in find_segments(t, weights))) for t in b])

    found = F.pandas_udf(run, "array<struct<pii_type:string,pii_text:string>>")
    return rows.select(*keep, F.explode(found(F.col("_text"))).alias("_i")).select(*keep, "_i.pii_type", "_i.pii_text")


def redacted(df: DataFrame, keep: list[str], text: str, weights: dict[str, float], out: str = "redacted") -> DataFrame:
    """(keep columns, out): the texts with typed placeholders; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: redact_text(t, weights), na_action="ignore")

    return df.select(*keep, F.pandas_udf(run, "string")(F.col(text)).alias(out))
