"""Subject areas of documents: classifier chains over term, source and structure features.

Terms: a sentence model (naive Bayes over one- and two-word terms, refined by expectation maximization, as labels hold
for documents and are incomplete and partly wrong) says what each sentence is about. Its shares of the document's
sentences and the strength of the terms themselves are, with source, language and structure, the features of a chain of
logistic classifiers; each link also sees the labels before it, which models what occurs together. Probabilities are
calibrated for labels left out, on halves of the labelled documents that the calibrated model has not seen, and beam
search decodes the best label combination.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Languages are told apart by script and small words; terms are fitted for each. "other" holds all remaining scripts.
LANGUAGES = ("en", "es", "zh", "de", "fr", "pt", "it", "ja", "ko", "ru", "ar", "other")
# Small words of languages in Latin letters.
_SMALL = {
    "en": "the of and is to was for that it you in with not are which".split(), "es": "el la los las que una por con del para se lo está entre según".split(),
    "de": "der die das und ist nicht ein eine mit für auf den von zu im".split(), "fr": "le les des et est une dans pour que qui sur pas au avec ce".split(),
    "pt": "o os as um uma não em na no ao com são pelo mais foi".split(), "it": "il gli di che è per non sono della nel anche più alla ma dei".split(),
}
# First and last letter of scripts; those of the first kind are written without blanks, letter by letter.
_SCRIPTS = {"ja": "\u3041\u30ff", "zh": "\u4e00\u9fff", "ko": "\uac00\ud7a3", "ru": "\u0400\u052f", "ar": "\u0600\u06ff"}
#: Sources reach the chain as one of so many features by hash, however many there are.
SOURCE_FEATURES = 64


@dataclass(frozen=True)
class SubjectConfig:
    """max_train_docs and max_train_chars bound the labelled documents that are fitted; everything else covers all documents."""

    max_train_docs: int = 6_000
    max_train_chars: int = 40_000_000
    em_rounds: int = 4
    min_count: int = 3
    min_gain: float = 0.7
    shrink: float = 40.0
    beam: int = 5


class Terms(NamedTuple):
    """Terms of a language (words and pairs of words) and the log ratio of each subject's use of them to that of all."""

    one: list[str]
    two: list[tuple[str, str]]
    gain: np.ndarray  # rows of one, then of two


@dataclass
class SubjectModel:
    subjects: list[str]
    terms: dict[str, Terms]
    chain: np.ndarray | None = None
    kept: np.ndarray | None = None  # share of true labels that labellers give: [link, another label before it]


class Tokens(NamedTuple):
    code: np.ndarray  # token, as a position in words
    doc: np.ndarray
    sentence: np.ndarray  # numbered through all documents
    words: list[str]
    sentences: np.ndarray  # of each document
    lang: np.ndarray


# Kinds of characters: a letter or mark, a letter that is a word by itself, an end of a sentence, an end of one before a blank.
_LETTER, _ALONE, _END, _DOT, _UNKNOWN = 1, 2, 3, 4, 255
_BLANK = np.isin(np.arange(256), list(b" \t\n\f\r"))


@cache
def _kinds() -> np.ndarray:
    """Kind of each code point; those beyond ASCII are unknown until they occur."""
    kinds = np.full(0x110000, _UNKNOWN, np.uint8)
    kinds[:128] = 0
    for chars, kind in (("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", _LETTER), ("\n", _END), (".!?", _DOT)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


def _kind(points: np.ndarray) -> np.ndarray:
    kinds = _kinds()
    out = kinds[points]
    if (out == _UNKNOWN).any():
        new = np.zeros(len(kinds), bool)
        new[points[out == _UNKNOWN]] = True
        new = np.flatnonzero(new)
        chars = pa.array([chr(c) for c in new])
        like = lambda pattern: pc.match_substring_regex(chars, pattern=pattern).to_numpy(zero_copy_only=False)
        kind = np.where(like(r"[\p{L}\p{M}]"), np.where(like(r"[\x{3041}-\x{30ff}\x{4e00}-\x{9fff}]"), _ALONE, _LETTER), 0)
        kinds[new] = np.where(like("[。！？]"), _END, kind)
        out = kinds[points]
    return out


def _characters(data: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte of UTF-8 belongs to."""
    kind = _kinds()[data]
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        more = 1 + (data[first] >= 0xE0) + (data[first] >= 0xF0)  # bytes after the first
        point = data[first].astype(np.int64) & np.array([0, 0x1F, 0x0F, 0x07])[more]
        for i in (1, 2, 3):
            at = first[more >= i] + i
            point[more >= i] = point[more >= i] << 6 | data[at] & 0x3F
        of = _kind(point)
        kind[first] = of
        for i in (1, 2, 3):
            kind[first[more >= i] + i] = of[more >= i]
    return kind


def tokenize(texts: pa.Array) -> Tokens:
    """Words (single characters in Chinese) of whole texts, by sentence; headers, speaker marks and digits are left out."""
    arr = pc.utf8_lower(pc.fill_null(texts, ""))
    if pc.any(headed := pc.match_substring(arr, "[")).as_py():
        bare = pc.replace_substring_regex(arr.filter(headed), pattern=r"(?m)^[ \t]*\[[^\]\n]*\][ \t]*$", replacement="")
        arr = pc.replace_with_mask(arr, headed, bare)
    n, arr = len(arr), arr.cast(pa.large_string())
    begin = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    begin = begin - begin[0]
    kind = _characters(data)
    stop = kind == _END
    dot = np.flatnonzero(kind == _DOT)
    stop[dot] = _BLANK[data[np.minimum(dot + 1, len(data) - 1)]]
    last = begin[1:][begin[1:] > begin[:-1]] - 1
    stop[last] |= kind[last] == _DOT
    letter = (kind == _LETTER) | (kind == _ALONE)
    start = letter.copy()
    start[1:] &= (kind[1:] != _LETTER) | (kind[:-1] != _LETTER)
    text = begin[:-1][begin[1:] > begin[:-1]]
    start[text] = letter[text]
    start &= data & 0xC0 != 0x80
    offsets = np.append(np.flatnonzero(start[letter]), np.count_nonzero(letter))
    enc = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[letter])]).dictionary_encode()
    code, words = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary.to_pylist()
    marks = np.flatnonzero(start | stop)
    stops = stop[marks]
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(marks[~stops], begin)))
    sentence = np.cumsum(stops)[~stops]
    if len(sentence):  # numbers without holes
        sentence = np.cumsum(np.concatenate([[0], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, np.int64)
    count = np.bincount(doc[first], minlength=n)
    small = {w: LANGUAGES.index(k) for k in reversed(_SMALL) for w in _SMALL[k]}
    script = np.full(len(words), -1, np.int64)
    told = np.full(len(words), -1, np.int64)
    for i, w in enumerate(words):
        if w[:1] >= "\u0370":
            script[i] = next((LANGUAGES.index(k) for k, (lo, hi) in _SCRIPTS.items() if lo <= w[0] <= hi), len(LANGUAGES) - 1)
        else:
            told[i] = small.get(w, -1)
    total = np.bincount(doc, minlength=n)
    votes, of = (_table(doc, x[code], n, len(LANGUAGES)) for x in (told, script))
    lang = votes.argmax(1)  # the first of the list where nothing tells
    # a document mostly of another script has the language of that script; kana tell Japanese from Chinese
    foreign = 2 * of.sum(1) > total
    kana = LANGUAGES.index("ja")
    lang = np.where(foreign, np.where(10 * of[:, kana] > total, kana, of.argmax(1)), lang)
    return Tokens(code, doc, sentence, words, count, lang)


def _table(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """How often each row meets each column; columns below 0 do not count."""
    some = column >= 0
    return np.bincount(row[some] * columns + column[some], minlength=rows * columns).reshape(rows, columns)


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting; without an inverse it hashes numbers, which took far longer on the terms of 6,000 documents."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _pairs(t: Tokens, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Position of the first word of each two-word term within a sentence; one, two: which tokens may be its words."""
    return np.flatnonzero(one[:-1] & two[1:] & (t.sentence[1:] == t.sentence[:-1])) if len(one) > 1 else np.zeros(0, np.int64)


def _fit_terms(t: Tokens, lang: int, labels: list[set[int]], n: int, cfg: SubjectConfig) -> Terms:
    """Terms of one language; class n is small talk.

    Counts of a class are shrunk towards the whole language, so that a class of few labelled documents claims little.
    """
    mask = t.lang[t.doc] == lang
    at = _pairs(t, mask, mask)
    one = np.flatnonzero(mask)
    keys = np.concatenate([t.code[one], (t.code[at] + 1) * len(t.words) + t.code[at + 1]])
    sentence, doc = np.concatenate([t.sentence[one], t.sentence[at]]), np.concatenate([t.doc[one], t.doc[at]])
    if not len(keys):
        return Terms([], [], np.zeros((0, n), np.float32))
    uniq, ids = np.unique(keys, return_inverse=True)
    once = _distinct(ids * np.int64(len(labels)) + doc)
    frequent = np.bincount(once // len(labels), minlength=len(uniq)) >= cfg.min_count
    occurrence = _distinct(ids[frequent[ids]] * np.int64(t.sentence[-1] + 1) + sentence[frequent[ids]])  # once per sentence
    ids, sent = occurrence // (t.sentence[-1] + 1), occurrence % (t.sentence[-1] + 1)
    doc_of = np.zeros(t.sentence[-1] + 1, np.int64)
    doc_of[t.sentence] = t.doc
    renum = np.cumsum(frequent) - 1
    ids, uniq = renum[ids], uniq[frequent]
    by_sentence = np.sort(sent * np.int64(len(uniq)) + ids) % max(1, len(uniq))  # terms; sent has the sentences by term
    if not len(uniq):
        return Terms([], [], np.zeros((0, n), np.float32))
    weight = 1 / np.sqrt(np.maximum(1, t.sentences))[doc_of]  # long documents must not drown the others
    allowed = np.full((len(labels), n + 1), 0.01)
    allowed[:, n] = 0.15
    for d, ls in enumerate(labels):
        for k in ls:
            allowed[d, k] = 0.85 / len(ls)
    allowed /= allowed.sum(1, keepdims=True)
    prior = np.log(allowed[doc_of])
    post = allowed[doc_of]
    ratio = np.zeros((len(uniq), n + 1), order="F")
    of_term, of_sentence = np.bincount(ids), np.bincount(sent, minlength=len(prior))
    # sums go over the other order, which adds to another place each time: that is faster, and the same terms in the same order
    whole = np.bincount(by_sentence, weights=np.repeat(weight, of_sentence), minlength=len(uniq))
    whole /= whole.sum()
    for _ in range(cfg.em_rounds):
        score = prior.copy(order="F")
        for k in range(n + 1):
            c = np.bincount(by_sentence, weights=np.repeat(post[:, k] * weight, of_sentence), minlength=len(uniq))
            ratio[:, k] = np.log((c + cfg.shrink * whole) / (c.sum() + cfg.shrink) / whole)
            score[:, k] += np.bincount(sent, weights=np.repeat(ratio[:, k], of_term), minlength=len(prior))
        post = np.exp(score - score.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    keep = np.flatnonzero(ratio[:, :n].max(1) >= cfg.min_gain)
    v = len(t.words)
    singles, doubles = keep[uniq[keep] < v], keep[uniq[keep] >= v]
    return Terms(
        [t.words[uniq[i]] for i in singles], [(t.words[(uniq[i] - v) // v], t.words[(uniq[i] - v) % v]) for i in doubles], ratio[np.concatenate([singles, doubles]), :n].astype(np.float32)
    )


class Evidence(NamedTuple):
    """What the terms of each document say of each subject."""

    shares: np.ndarray  # of its sentences
    mean: np.ndarray  # gain of its terms per sentence
    best: np.ndarray  # gain of the best sentence


def subject_evidence(model: SubjectModel, t: Tokens) -> Evidence:
    """Share of the sentences of each document that each subject holds, and the strength of its terms."""
    n, k = len(t.sentences), len(model.subjects)
    if not len(t.code):
        return Evidence(*np.zeros((3, n, k)))
    where = {w: i for i, w in enumerate(t.words)}
    sents = int(t.sentence[-1]) + 1
    doc_of = np.zeros(sents, np.int64)
    doc_of[t.sentence] = t.doc
    # a document has one language: its words stand at the slot of that, and those of a language without terms at the last
    names = [name for lang in np.unique(t.lang) if (name := LANGUAGES[lang]) in model.terms and len(model.terms[name].gain)]
    v = len(t.words)
    row, known, gains = np.full((len(names) + 1) * v, -1), [], [np.zeros((0, k))]
    slot = np.full(len(LANGUAGES), len(names) * v)
    for i, name in enumerate(names):
        terms, before = model.terms[name], sum(map(len, gains))
        gains.append(terms.gain)
        slot[LANGUAGES.index(name)] = i * v
        for j, w in enumerate(terms.one, before):
            if w in where:
                row[i * v + where[w]] = j
        known += [((i * v + where[a]) * v + where[b], j) for j, (a, b) in enumerate(terms.two, before + len(terms.one)) if a in where and b in where]
    code = slot[t.lang][t.doc] + t.code
    found = row[code]
    one = np.flatnonzero(found >= 0)
    hit, s = found[one], t.sentence[one]
    if known:
        keys, rows = np.array(sorted(known), np.int64).T
        ends = np.zeros((2, len(row)), bool)
        ends[0, keys // v] = ends[1, keys % v] = True
        at = _pairs(t, ends[0, code], ends[1, t.code])
        key = code[at] * v + t.code[at + 1]
        pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[pos] == key
        hit, s = np.concatenate([hit, rows[pos[ok]]]), np.concatenate([s, t.sentence[at[ok]]])
    gain = np.concatenate(gains).astype(float).T.copy()
    score = np.stack([np.bincount(s, weights=g[hit], minlength=sents) for g in gain], 1)
    mean, top = np.zeros((n, k)), np.zeros((n, k))
    for j in range(k):
        mean[:, j] = np.bincount(doc_of, weights=score[:, j], minlength=n)
    first = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    top[doc_of[first]] = np.maximum.reduceat(score, first, axis=0)
    about = np.where(score.max(1) >= 1.0, score.argmax(1), -1)
    each = np.maximum(1, t.sentences)[:, None]
    return Evidence(_table(doc_of, about, n, k) / each, np.clip(mean / each, -2, 4) / 4, np.clip(top, 0, 12) / 12)


# --- the chain --------------------------------------------------------------------------------------------------------


def _source(values: pd.Series) -> pd.Series:
    return values.fillna("").str.strip().str.lower()


def _static(t: Tokens, source: pd.Series) -> np.ndarray:
    """Source and structure features of each document; a missing source is a source of its own."""
    slot = _source(source).map(lambda x: xxhash.xxh32_intdigest(x) % SOURCE_FEATURES).to_numpy(np.int64)
    out = np.zeros((len(slot), 2 + len(LANGUAGES) + SOURCE_FEATURES))
    row = np.arange(len(slot))
    out[:, 0], out[:, 1] = 1, np.log1p(t.sentences) / 5
    out[row, 2 + t.lang] = 1
    out[row, 2 + len(LANGUAGES) + slot] = 1
    return out


def _link(e: Evidence, k: int, static: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Features of link k; before: the labels of the links before it, 0 for later ones."""
    s = e.shares[:, k]
    other = np.delete(e.shares, k, 1).max(1) if e.shares.shape[1] > 1 else np.zeros(len(s))
    bends = np.stack([np.clip((s - a) / w, 0, 1) for a, w in ((0.0, 0.15), (0.15, 0.15), (0.28, 0.1), (0.4, 0.2), (0.6, 0.4))], 1)
    terms = np.stack([e.mean[:, k], e.best[:, k], other], 1)
    return np.concatenate([static, bends, terms, before, before.sum(1, keepdims=True) > 0], 1)


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """times: how often each row counts."""
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + pull
        step = np.linalg.solve(h, x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:  # steps shrink by their square: the next one is below rounding
            break
    return w


def _take(t: Tokens, docs: np.ndarray) -> Tokens:
    """The tokens of some documents (a mask), numbered anew."""
    keep = docs[t.doc]
    new = np.cumsum(docs) - 1
    sentence = t.sentence[keep]
    if len(sentence):
        sentence = np.cumsum(np.concatenate([[0], sentence[1:] != sentence[:-1]]))
    return Tokens(t.code[keep], new[t.doc[keep]], sentence, t.words, t.sentences[docs], t.lang[docs])


def _rows(e: Evidence, docs: np.ndarray) -> Evidence:
    return Evidence(*(x[docs] for x in e))


def _fit_chain(model: SubjectModel, e: Evidence, static: np.ndarray, y: np.ndarray) -> np.ndarray:
    # only documents with a subject get labels; what has no sentence on any subject has none, which must be learned too
    rows, times = np.unique(static, axis=0, return_counts=True)
    none = np.zeros((len(rows), y.shape[1]))
    e = Evidence(*(np.concatenate([x, none]) for x in e))
    static, y, times = np.concatenate([static, rows]), np.concatenate([y, none]), np.concatenate([np.ones(len(y)), times])
    links = range(len(model.subjects))
    return np.stack([_logistic(_link(e, k, static, np.where(np.arange(len(links)) < k, y, 0)), y[:, k], times) for k in links])


def _fit(t: Tokens, static: np.ndarray, have: list[set[int]], y: np.ndarray, subjects: list[str], cfg: SubjectConfig) -> SubjectModel:
    model = SubjectModel(subjects, {name: _fit_terms(t, i, have, len(subjects), cfg) for i, name in enumerate(LANGUAGES)})
    model.chain = _fit_chain(model, subject_evidence(model, t), static, y)
    return model


def fit_subjects(texts: pa.Array, source: pd.Series, labels: list[set[str]], subjects: list[str], cfg: SubjectConfig = SubjectConfig()) -> SubjectModel:
    """Fit terms and chain on labelled documents. Labels may be missing or wrong; unknown subjects are ignored.

    Calibration: of documents that are clearly about a subject, the mean probability under a model fitted on the other
    half of the documents is the share of true labels that labellers give.
    """
    no = {s: i for i, s in enumerate(subjects)}
    have = [{no[s] for s in ls if s in no} for ls in labels]
    t = tokenize(texts)
    static = _static(t, source)
    y = np.zeros((len(have), len(subjects)))
    for d, ls in enumerate(have):
        y[d, list(ls)] = 1
    model = _fit(t, static, have, y, subjects, cfg)
    told, clear_docs = np.full((len(subjects), 2), 1.6), np.full((len(subjects), 2), 2.0)
    half = np.arange(len(have)) % 2 == 0
    for seen in (half, ~half):
        if not seen.any() or seen.all():
            continue
        other = _fit(_take(t, seen), static[seen], [x for x, s in zip(have, seen) if s], y[seen], subjects, cfg)
        e, held = subject_evidence(other, _take(t, ~seen)), y[~seen]
        for k in range(len(subjects)):
            before = np.where(np.arange(len(subjects)) < k, held, 0)
            p = 1 / (1 + np.exp(-np.clip(_link(e, k, static[~seen], before) @ other.chain[k], -30, 30)))
            for some in (0, 1):
                clear = (e.shares[:, k] >= 0.4) & ((before.sum(1) > 0) == some)
                told[k, some] += p[clear].sum()
                clear_docs[k, some] += clear.sum()
    model.kept = told / clear_docs
    return model


def decode(model: SubjectModel, e: Evidence, static: np.ndarray, beam: int) -> np.ndarray:
    """The likeliest label combination of each document, by beam search along the chain."""
    n, k = e.shares.shape
    paths, logp = np.zeros((n, 1, k)), np.zeros((n, 1))
    for j in range(k):
        some = (paths.sum(2) > 0).astype(int)
        # the labels before are the last features of a link; all others are the same on each path
        x = (_link(e, j, static, np.zeros((n, k))) @ model.chain[j])[:, None] + paths @ model.chain[j][-k - 1 : -1] + some * model.chain[j][-1]
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        p = np.clip(p / model.kept[j, some], 1e-6, 1 - 1e-6)
        yes = paths.copy()
        yes[:, :, j] = 1
        paths, logp = np.concatenate([paths, yes], 1), np.concatenate([logp + np.log1p(-p), logp + np.log(p)], 1)
        if paths.shape[1] > beam:
            top = np.argpartition(-logp, beam - 1, 1)[:, :beam]
            paths, logp = np.take_along_axis(paths, top[:, :, None], 1), np.take_along_axis(logp, top, 1)
    return paths[np.arange(n), logp.argmax(1)]


def predict(model: SubjectModel, texts: pa.Array, source: pd.Series, beam: int = 5) -> np.ndarray:
    t = tokenize(texts)
    return decode(model, subject_evidence(model, t), _static(t, source), beam)


def _training_sample(documents: DataFrame, given: DataFrame, cfg: SubjectConfig) -> pa.Table:
    """Texts, sources and labels of the labelled documents that are fitted: the first max_train_docs by hash of their id,
    as long as their texts stay below max_train_chars together. Ids and lengths are drawn first, then those texts only."""
    labelled = documents.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n")).join(given.select("doc_id"), "doc_id")
    drawn = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_train_docs).collect()
    ids, chars = [], 0
    for r in drawn:
        if chars + r.n <= cfg.max_train_chars:
            ids.append((r.doc_id,))
            chars += r.n
    wanted = F.broadcast(documents.sparkSession.createDataFrame(ids, "doc_id long"))  # at most max_train_docs ids
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", "source").join(wanted, "doc_id", "left_semi")
    return texts.join(given, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, cfg: SubjectConfig = SubjectConfig()) -> DataFrame:
    """(doc_id, subject, n_chars, source): one row per document and subject area it is about.

    Null and empty texts are about nothing; documents without labels are decoded like all others. Repeated label rows
    count once, labels of unknown documents or areas not at all. Without any label the result is empty. The whole text
    counts, whatever its length. At most max_train_docs labelled documents, by hash of their id, are fitted; SubjectConfig
    bounds their texts too.
    """
    subjects = sorted({r.subject for r in areas.select("subject").distinct().collect() if r.subject is not None})
    given = labels.where(F.col("subject").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    train = _training_sample(documents, given, cfg)
    schema = "doc_id long, subject string"
    if not train.num_rows:
        return documents.sparkSession.createDataFrame([], schema)
    model = fit_subjects(train.column("text").combine_chunks(), train.column("source").to_pandas(), [set(x) for x in train.column("subjects").to_pylist()], subjects, cfg)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                y = predict(m, b.column("text"), b.column("source").to_pandas(), cfg.beam)
                d, k = np.nonzero(y)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([m.subjects[i] for i in k], pa.string())], names=["doc_id", "subject"])

    return documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text", "source").mapInArrow(run, schema)
