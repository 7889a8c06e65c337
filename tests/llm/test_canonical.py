"""The consistent form of texts that look the same."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.llm.canonical import LOOKALIKES, base_letters, canonical_text, public_letters, same_look_pairs, with_canonical


@pytest.mark.parametrize(
    "stored",
    ["café reсord", "ｃａｆé record", "ca​f­é record", "café record", "café　record", "café record", "﻿café rеcоrd", "café reco⁠rd"],
)
def test_same_look(stored):
    assert canonical_text(stored) == canonical_text("café record")


@pytest.mark.parametrize("other", ["cafe record", "Café record", "café  record", "café\nrecord", "café reкord", "café record."])
def test_other_look(other):
    assert canonical_text(other) != canonical_text("café record")


def test_scripts():
    assert canonical_text("ѕсоре") == "scope" and canonical_text("поле сор") == "поле сор"
    assert canonical_text("Мы видели pocy") == canonical_text("Мы видели росу")
    assert canonical_text("ﬁre ﬂy") == "fire fly" and canonical_text("x² ½") == "x² ½"
    assert canonical_text("👩‍💻 ok‍") == "👩‍💻 ok" and canonical_text("a\r\nb") == canonical_text("a\nb")
    assert canonical_text(None) is None and canonical_text("") == ""
    assert all(len(a) == len(b) for a, b in LOOKALIKES.values())


@given(st.text(max_size=60))
def test_form_of_a_form_is_the_form(text):
    once = canonical_text(text)
    assert canonical_text(once) == once


@given(st.text(alphabet="abcopexy éïñ漢字。,", max_size=40))
def test_disguises_are_undone(text):
    text = unicodedata.normalize("NFC", text)
    table = {a: b for a, b in zip(*LOOKALIKES["Cyrillic"])}
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in text)
    assert canonical_text(unicodedata.normalize("NFD", text)) == canonical_text(text) == canonical_text(wide)
    assert canonical_text("".join(table.get(c, c) for c in text)) == canonical_text(text)


def test_pairs(spark):
    rows = [("w", 1, "Ask now"), ("w", 2, "Аsk now"), ("w", 3, "Ask now"), ("w", 4, "ask now"), ("w", 5, None), ("w", 6, ""), ("w", 2, "Аsk now"), ("m", 1, "Аsk now"), ("m", 9, "x" * 100000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "src string, id long, text string, _form string")
    assert sorted(tuple(r) for r in same_look_pairs(df, "src", "id", "text").collect()) == [("w", 1, 2), ("w", 2, 3)]
    assert same_look_pairs(df.limit(0), "src", "id", "text").count() == 0


@pytest.mark.parametrize(
    "stored,plain",
    [("ρaypal", "paypal"), ("ɑpple", "apple"), ("Ꭺpple", "Apple"), ("5 µg", "5 μg"), ("𝐁old", "Bold"), ("ꓮꓑꓑꓡꓰ", "ꓮꓑꓑꓡꓰ"), ("Ⲥode", "Code"), ("sκip", "sκip"), ("раураl", "paypal"), ("ΑΒΕ", "ABE"), ("Google Ꮲlay", "Google Play")],
)
def test_public_list(spark, stored, plain):
    letters = public_letters(spark)
    assert canonical_text(stored, letters) == canonical_text(plain, letters)
    assert len(letters.spell) > len(base_letters().spell)


@pytest.mark.parametrize("a,b", [("kıt", "kit"), ("straße", "strabe"), ("год", "roд"), ("łódź", "lódź"), ("Il", "ll"), ("O0", "00"), ("øre", "ore"), ("rn", "m")])
def test_public_list_keeps_letters_of_another_look(spark, a, b):
    letters = public_letters(spark)
    assert canonical_text(a, letters) != canonical_text(b, letters)


def test_forms_of_a_table(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "Ꭺpple"), (5, "a\r\nb"), (6, "long " * 50000 + "Ꭺ")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.form for r in with_canonical(df, "text", "form").collect()}
    assert [got[i] for i in range(1, 6)] == [None, "", "plain", "Apple", "a\nb"] and got[6].endswith("A")
