"""One consistent form for texts that look the same.

Each token's letters are resolved to the sets of scripts in which they could have been written (look-alike letters
belong to several); the sets are intersected over the token. A token whose own spelling mixes scripts, or which could
be whole in more than one script, is written in the script that fits: the only one of the intersection, or, where
several fit, the one that the unambiguous tokens of the text use most. Remaining forms (full-width, ligatures,
composed letters, kinds of blanks, invisible characters) are normalized character by character.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The base list, which needs no session: letters of other scripts that look like a Latin letter, as pairs of
# (Latin letters, other letters). ``public_letters`` has all of them.
LOOKALIKES = {
    "Cyrillic": ("acdehijlopqsvwxyABCEHIJKMOPSTXYGQW", "асԁеһіјӏорԛѕѵԝхуАВСЕНІЈКМОРЅТХҮԌԚԜ"),
    "Greek": ("ovABEZHIKMNOPTYXF", "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜ"),
    "Armenian": ("ohnuqgOSULj", "օհոսզցՕՏՍԼյ"),
}

# Presentation ligatures of joined Latin and Armenian letters are those of the block FB00 to FB17.
_LIGATURES = [chr(c) for c in range(0xFB00, 0xFB18) if unicodedata.category(chr(c)) != "Cn"]
# Marks that show nothing although they are no format characters.
_INVISIBLE_MARKS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# Hyphens that look like the hyphen-minus, and line ends that look like a line feed.
_HYPHENS, _LINE_ENDS = [0x2010, 0x2011], [0x0085, 0x2028, 0x2029]
# Latin letters of another name that look like a common one.
_SAME_SCRIPT = {0x0251: "a", 0x0261: "g"}
# Scripts that share letter shapes with Latin, and letters of the public list whose look is another one.
SHARING = "Greek Cyrillic Armenian Cherokee Coptic Lisu Deseret Osage Warang_Citi".split()
_OTHER_LOOK = frozenset("σγιϲϳᴦ гҽүѡꙇ քցոռգա ⲅⲥ Ꮤꭵ")
ZWJ = "‍"


@lru_cache(1)
def _char_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cf" and ch != ZWJ:
            table[c] = None
        elif cat == "Zs":
            table[c] = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) or 0x1D400 <= c < 0x1D800 and cat != "Cn" or c == 0xB5:
            table[c] = unicodedata.normalize("NFKC", ch)
    table |= {ord(x): unicodedata.normalize("NFKC", x) for x in _LIGATURES}
    table |= _SAME_SCRIPT
    table |= dict.fromkeys(_INVISIBLE_MARKS) | dict.fromkeys(_HYPHENS, "-") | dict.fromkeys(_LINE_ENDS, "\n")
    return table


class Letters(NamedTuple):
    """Look-alike letters: the spelling of each in each script in which it may be written."""

    spell: dict[str, dict[str, str]]
    scripts: dict[str, frozenset[str]]


def _letters(classes: dict[str, dict[str, str]]) -> Letters:
    spell = {ch: forms for forms in classes.values() for ch in forms.values()}
    return Letters(spell, {ch: frozenset(forms) for ch, forms in spell.items()})


@lru_cache(1)
def base_letters() -> Letters:
    classes: dict[str, dict[str, str]] = {}
    for script, (latin, other) in LOOKALIKES.items():
        assert len(latin) == len(other)
        for a, b in zip(latin, other):
            classes.setdefault(a, {"Latin": a})[script] = b
    return _letters(classes)


@lru_cache(4)
def _public(jvm_id: int, spark: SparkSession) -> Letters:
    pattern = regex.compile("|".join(rf"(?P<{s}>\p{{Script={s}}})" for s in SHARING))
    found = [(chr(c), m.lastgroup) for c in range(0x370, 0x12000) if chr(c).isalpha() and (m := pattern.match(chr(c)))]
    latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    looks = checker.getSkeleton("\n".join([*latin, *(ch for ch, _ in found)])).split("\n")
    # letters are the same look if their prototypes are and both are capitals or small letters; l and I share a prototype
    case = lambda ch, look: unicodedata.category(ch) if unicodedata.category(ch) != "Lo" else "Lu" if look.isupper() or look == "l" else "Ll"
    plain = {(look, case(ch, look)): ch for ch, look in zip(latin, looks)}
    classes = {a: {"Latin": a} for a in latin}
    for script, (ours, other) in LOOKALIKES.items():
        for a, b in zip(ours, other):
            classes[a][script] = b
    listed = {ch for forms in classes.values() for ch in forms.values()}
    for (ch, script), look in zip(found, looks[len(latin) :], strict=True):
        a = plain.get((look, case(ch, look)))
        if a and ch not in listed and ch not in _OTHER_LOOK and unicodedata.normalize("NFD", ch) == ch:
            classes[a].setdefault(script, ch)
    return _letters({a: forms for a, forms in classes.items() if len(forms) > 1})


def public_letters(spark: SparkSession) -> Letters:
    """All look-alikes of Latin letters by the public confusables data (the ICU library that comes with Spark), with the
    base list where both name a letter. Letters of which only part of the look agrees are left out. The table has a few
    hundred letters and goes to the executors with the function that uses it. If the library gives no whole answer, that
    is an error: forms by the base list alone would look like a result and leave out equal texts."""
    try:
        return _public(id(spark._jvm), spark)
    except Exception as e:
        raise RuntimeError("the look-alike letters cannot be read from the ICU library of the session's JVM") from e


@lru_cache(100_000)
def _own_scripts(ch: str) -> frozenset[str]:
    """Scripts a letter is used in by its script extensions; the first word of its name for scripts outside the list."""
    mine = frozenset(s for s in ("Latin", *SHARING) if regex.match(rf"\p{{scx={s}}}", ch))
    name = unicodedata.name(ch, "")
    return mine or frozenset([name.split(" ", 1)[0].title() if name else ""])


def _scripts_of(ch: str, letters: Letters) -> frozenset[str]:
    return letters.scripts.get(ch) or _own_scripts(ch)


# Runs of letters of scripts that are written with blanks between words; Chinese and Japanese letters end a run.
_TOKEN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ʯ̀-ͯͰ-῿Ⱡ-ⷿ\ua4d0-\ua4ffꙀ-ퟻ豈-﫿\U00010400-\U000104ff\U000118a0-\U000118ff]+")
# Letters of the scripts that have look-alikes of Latin ones; a text without them needs no script resolution.
_OTHER_SCRIPT = re.compile("[Ͱ-֏\u13a0-\u13ffἀ-῿\u2c80-\u2cff\ua4d0-\ua4ff\uab70-\uabbf\U00010400-\U000104ff\U000118a0-\U000118ff]")
# Any character outside of these needs work beyond composition; a text without one is in its final form if composed.
_SPECIAL = re.compile(r"[^\x00-\x0c\x0e-\x7e¡-¬®-´¶-\u0250\u0252-\u0260\u0262-\u034e\u0350-\u036e、-〠぀-ヿ一-鿿‒-‧]")


def _pictograph(ch: str) -> bool:
    return unicodedata.category(ch) == "So" or "\U0001f3fb" <= ch <= "\U0001f3ff" or ch == "️"


def _join_only_pictographs(text: str) -> str:
    """Keep zero-width joiners only where they fuse two pictographs into one picture."""
    out = []
    for i, ch in enumerate(text):
        if ch != ZWJ or (0 < i < len(text) - 1 and _pictograph(text[i - 1]) and _pictograph(text[i + 1])):
            out.append(ch)
    return "".join(out)


def _options(token: str, letters: Letters) -> frozenset[str]:
    sets = {_scripts_of(ch, letters) for ch in token if unicodedata.category(ch)[0] == "L"}
    return frozenset.intersection(*sets) if sets else frozenset()


def _one_script(text: str, letters: Letters) -> str:
    """Write each token in the one script that fits it; letters with marks are seen as letter and mark."""
    text = unicodedata.normalize("NFD", text)
    tokens = [(m.group(), _options(m.group(), letters)) for m in _TOKEN.finditer(text)]
    use = Counter(next(iter(o)) for _, o in tokens if len(o) == 1)
    spell = letters.spell

    def pick(m: re.Match) -> str:
        token = m.group()
        options = _options(token, letters)
        if not options:  # no script holds the whole token: the script of the rest for each look-alike, Latin if unclear
            rest = Counter(next(iter(s)) for ch in token if len(s := _scripts_of(ch, letters)) == 1)
            best = max(rest, key=lambda s: (rest[s], s)) if rest else "Latin"
        else:
            best = max(options, key=lambda s: (use.get(s, 0), s == "Latin", s))
        return "".join(spell[ch].get(best) or spell[ch]["Latin"] if ch in spell else ch for ch in token)

    return _TOKEN.sub(pick, text)


def canonical_text(text: str | None, letters: Letters | None = None) -> str | None:
    """The consistent form of a text; texts have equal forms just if a reader sees them as equal.

    ``letters`` are the look-alikes, the base list if not given. A dotless i and other letters that differ in a dot, a
    stroke or a bow have another look.

    Null stays null, the empty text stays empty, of any length the whole text is processed. Letter case, accents, the
    number of blanks and letters of another look stay as they are. The form of a form is the form itself.
    """
    if text is None or text.isascii() and "\r" not in text and "\x7f" not in text:
        return text
    if _SPECIAL.search(text) is None:
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_char_table()).replace("\x7f", "")
    if ZWJ in text:
        text = _join_only_pictographs(text)
    text = unicodedata.normalize("NFC", text)
    if _OTHER_SCRIPT.search(text):
        text = unicodedata.normalize("NFC", _one_script(text, letters or base_letters()))
    return text


def is_ascii(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.length(c) == F.octet_length(c)


def _needs_work(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return ~is_ascii(c) | F.contains(c, F.lit("\r")) | F.contains(c, F.lit("\x7f"))


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the consistent form of a text column; null stays null. Plain ASCII texts stay in the JVM."""
    letters = public_letters(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: canonical_text(t, letters), na_action="ignore")

    form = F.pandas_udf(run, StringType())(F.when(_needs_work(text), F.col(text)))
    return df.withColumn(out, F.coalesce(form, F.col(text)))


def same_look_pairs(df: DataFrame, group: str, id_col: str, text: str) -> DataFrame:
    """Pairs (group, id_a, id_b), id_a < id_b, whose texts look the same but are stored differently.

    ``df`` has one group (source), id and text per row; repeated rows count once, null texts never match. ASCII texts
    are their own form, so only others go through Python; then 64-bit keys of form and text are compared, and only
    forms stored in several ways are joined. A hot form is split by AQE's skew join, as both sides are plain shuffles.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(id_col).alias("_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull() & F.col("_id").isNotNull())
    special = _needs_work("_t")
    ascii_rows = rows.where(~special).select("_g", "_id", F.xxhash64("_t").alias("_raw"), F.xxhash64("_t").alias("_form"))
    others = with_canonical(rows.where(special), "_t", "_c").select("_g", "_id", F.xxhash64("_t").alias("_raw"), F.xxhash64("_c").alias("_form"))
    keyed = ascii_rows.unionByName(others)
    several = keyed.groupBy("_g", "_form").agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).where("lo <> hi").select("_g", "_form")
    keyed = keyed.join(several, ["_g", "_form"], "left_semi").distinct()
    a, b = keyed.select("_g", "_form", F.col("_id").alias("_ia"), F.col("_raw").alias("_ra")), keyed.select("_g", "_form", F.col("_id").alias("_ib"), F.col("_raw").alias("_rb"))
    pairs = a.join(b, ["_g", "_form"]).where((F.col("_ia") < F.col("_ib")) & (F.col("_ra") != F.col("_rb")))
    return pairs.select(F.col("_g").alias(group), F.col("_ia").alias("id_a"), F.col("_ib").alias("id_b")).distinct()
