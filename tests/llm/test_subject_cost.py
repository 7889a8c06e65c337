"""What fitting and decoding of subject areas cost, and that the short ways give what the long ones define."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.llm import subjects
from palimpsest.llm.subjects import LANGUAGES, fit_subjects, subject_evidence, tokenize

ODD = list("abE .!?\n\t\r[]x1é ßİΣς。！？漢字かゝーガ・゛ｱ한국Русا́ ​　️😀𠀀١") + ["...", ".\n", "[h]\n", "\n[s 1]\n", " [t] \n", "กิ", "゚", "ǅ"]


def plain(texts):
    """Words and ends of sentences (\x01) of each text, by regular expressions."""
    arr = pc.utf8_lower(pc.fill_null(texts, ""))
    arr = pc.replace_substring_regex(arr, pattern=r"(?m)^[ \t]*\[[^\]\n]*\][ \t]*$", replacement="")
    arr = pc.replace_substring_regex(arr, pattern=r"[.!?]+(?:\s|$)|[。！？\n]+", replacement=" \x01 ")
    arr = pc.replace_substring_regex(arr, pattern=r"([\x{3041}-\x{30ff}\x{4e00}-\x{9fff}])", replacement=r" \1 ")
    return pc.split_pattern_regex(arr, pattern=r"[^\p{L}\p{M}\x01]+")


def sentences(words):
    out = [[]]
    for w in words:
        out[-1].append(w) if w not in ("", "\x01") else out.append([]) if w else None
    return [s for s in out if s]


def by_sentence(t):
    out = [[] for _ in t.sentences]
    for i, (c, d, s) in enumerate(zip(t.code, t.doc, t.sentence)):
        if not i or s != t.sentence[i - 1]:
            out[d].append([])
        out[d][-1].append(t.words[c])
    return out


def test_tokens_are_those_of_the_expressions():
    r = random.Random(4)
    texts = [None if r.random() < 0.05 else "".join(r.choice(ODD) for _ in range(r.choice([0, 1, 2, 5, 12, 40]))) for _ in range(4000)]
    t, want = tokenize(pa.array(texts)), [sentences(x) for x in plain(pa.array(texts)).to_pylist()]
    assert by_sentence(t) == want and list(t.sentences) == [len(x) for x in want]
    part = pa.array(["other", *texts[:50]]).slice(1)
    assert by_sentence(tokenize(part)) == want[:50]
    assert by_sentence(tokenize(pa.array(["a\x01b. c"]))) == [[["a", "b"], ["c"]]]


def test_only_headers_meet_expressions(monkeypatch):
    met, replace = [], pc.replace_substring_regex

    def counted(texts, **options):
        met.extend(texts.to_pylist())
        return replace(texts, **options)

    def refuse(*_, **__):
        raise AssertionError("whole texts are split by an expression")

    monkeypatch.setattr(pc, "replace_substring_regex", counted)
    monkeypatch.setattr(pc, "split_pattern_regex", refuse)
    t = tokenize(pa.array(["One two. Three", "[session 1]\nFour", "五。六"]))
    assert met == ["[session 1]\nfour"]
    assert by_sentence(t) == [[["one", "two"], ["three"]], [["four"]], [["五"], ["六"]]]


WORDS = {"law": ["court", "verdict", "appeal", "clause"], "sport": ["goal", "referee", "striker", "coach"]}
FOREIGN = {"law": ["法院", "判决"], "sport": ["球门", "裁判"]}


def model_and_texts():
    r = random.Random(8)
    texts, labels = [], []
    for _ in range(300):
        s, foreign = r.choice(list(WORDS)), r.random() < 0.3
        words = (FOREIGN if foreign else WORDS)[s]
        n = r.randrange(2, 6)
        texts.append("".join(f"我们看{r.choice(words)}和{r.choice(words)}。" if foreign else f"We note the {r.choice(words)} with the {r.choice(words)}. " for _ in range(n)) + "Thanks. ")
        labels.append({s})
    return texts, labels


def test_equal_empty_rows_are_fitted_once(monkeypatch):
    texts, labels = model_and_texts()
    seen, fit = [], subjects._logistic

    def logistic(x, *rest):
        seen.append((len(x), sum(map(np.sum, rest[1:]))))
        return fit(x, *rest)

    monkeypatch.setattr(subjects, "_logistic", logistic)
    fit_subjects(pa.array(texts), pd.Series(["x"] * len(texts)), labels, sorted(WORDS))
    assert seen[:2] == [(300 + 8, 600)] * 2  # 4 lengths in 2 languages stand for another 300


def test_evidence_is_that_of_each_sentence():
    texts, labels = model_and_texts()
    model = fit_subjects(pa.array(texts), pd.Series(["x"] * len(texts)), labels, sorted(WORDS))
    some = [*texts[:60], "", "court. goal! nothing here? 法院"]
    t = tokenize(pa.array(some))
    e = subject_evidence(model, t)
    assert len(set(t.lang)) == 2
    for d, lines in enumerate(by_sentence(t)):
        terms = model.terms[LANGUAGES[t.lang[d]]]
        rows = {w: i for i, w in enumerate([*terms.one, *terms.two])}
        score = np.array([sum((terms.gain[rows[w]].astype(float) for w in [*x, *zip(x, x[1:])] if w in rows), np.zeros(2)) for x in lines]).reshape(-1, 2)
        share = [sum(x.max() >= 1 and x.argmax() == k for x in score) / max(1, len(lines)) for k in range(2)]
        assert np.allclose(e.shares[d], share)
        assert np.allclose(e.mean[d], np.clip(score.sum(0) / max(1, len(lines)), -2, 4) / 4)
        assert np.allclose(e.best[d], np.clip(score.max(0, initial=0), 0, 12) / 12)
