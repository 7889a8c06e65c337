"""Near copies: improved consistent weighted sampling over shingles, banded, verified by weighted Jaccard.

Texts of the same shingles are first reduced to one class. A class is the set of its shingles numbered by occurrence,
so that the weighted Jaccard similarity of counts is that of plain sets. Elements are sampled with a power of their
inverse document frequency as weight. Power 0 samples the very similarity that is verified, so that the chance of a
wanted pair does not hang on how rare its edited words are; power 1 samples the TF-IDF vector. Inverse document
frequencies come from all documents, in a table of fixed size indexed by element hash (a proven bound for the broadcast).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.canonical import Letters, canonical_text, public_letters
from palimpsest.operators.graph import connected_components
from palimpsest.session import discard, materialize


@dataclass(frozen=True)
class NearDupConfig:
    """words_per_shingle 5 and threshold 0.8 unless the problem at hand says otherwise."""

    words_per_shingle: int = 5
    threshold: float = 0.8
    min_words: int = 1
    bands: int = 76
    rows_per_band: int = 7
    idf_power: float = 0.0
    df_bits: int = 18
    seed: int = 20240


#: Bits of the sketch that goes with each row of a band, and the turns in which the bands meet.
SKETCH_BITS, TURNS = 256, 8
#: Up to so many classes all bands meet in one turn.
ONE_TURN = 5_000
#: Elements from which on a text counts as long where least values are taken.
LONG_TEXT = 256
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]

WORDS = r"[^\p{L}\p{N}\p{M}]+"


def _words(texts: list[str], letters: Letters | None = None) -> pa.ListArray:
    """Lower-case words of each text in its consistent form."""
    arr = pa.array([canonical_text(t, letters) for t in texts], pa.string())
    return pc.split_pattern_regex(pc.utf8_lower(arr), pattern=WORDS)


def _hash_unique(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of each word in the dictionary, 64-bit hash of each dictionary entry; 0 for the empty word)."""
    enc = words.dictionary_encode()
    dic = enc.dictionary.to_pylist()
    h = np.fromiter((xxhash.xxh64_intdigest(w) | 1 if w else 0 for w in dic), np.uint64, len(dic))
    return enc.indices.to_numpy(zero_copy_only=False), h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _elements(texts: list[str], n: int, letters: Letters | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document no, element) of all shingles, sorted, and the number of words of each document.

    An element is a 32-bit hash of a shingle and its occurrence number within the document.
    """
    lists = _words(texts, letters)
    idx, h = _hash_unique(lists.flatten())
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    w = h[idx] if len(idx) else np.zeros(0, np.uint64)
    doc, w = doc[w != 0], w[w != 0]
    n_words = np.bincount(doc, minlength=len(texts))
    if n > 1 and len(w):
        s = w.copy()
        pos = np.arange(len(w)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        left = np.repeat(n_words, n_words) - pos
        for k in range(1, n):
            nxt = np.concatenate([w[k:], np.zeros(min(k, len(w)), np.uint64)])
            s = np.where(left > k, _mix(s * np.uint64(31) + nxt), s)
        keep = (left >= n) | (pos == 0)  # a text shorter than a shingle is one shingle
        doc, w = doc[keep], s[keep]
    # one 64-bit key of document and hash sorts faster than two columns; equal hashes follow each other
    top = doc.astype(np.uint64) << np.uint64(32)
    key = top | (w >> np.uint64(32))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    occ = (np.arange(len(key)) - start).astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    key = (key & ~low) | (_mix((key & low) * np.uint64(0xD6E8FEB86659FD93) + occ * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))
    key.sort()
    return (key >> np.uint64(32)).astype(np.int64), (key & low).astype(np.uint32), n_words


def _tokenized(df: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(g, id, cls, elements) of each text with at least min_words words.

    Only the first text of a class in a batch brings its elements, so that many copies of one text stay small.
    """
    letters = public_letters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, element, n_words = _elements(b.column("text").to_pylist(), cfg.words_per_shingle, letters)
            ok = n_words >= max(1, cfg.min_words)
            doc, element = doc[ok[doc]], element[ok[doc]]
            sizes = np.bincount(doc, minlength=len(ok))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            raw, rows = element.tobytes(), np.flatnonzero(ok)
            cls = np.fromiter((xxhash.xxh3_64_intdigest(raw[4 * offsets[i] : 4 * offsets[i + 1]]) for i in rows), np.uint64, len(rows))
            first = np.zeros(len(rows), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            kept = first[np.repeat(np.arange(len(rows)), sizes[rows])] if len(rows) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(np.where(first, sizes[rows], 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(element[kept].view(np.int32)), mask=pa.array(~first))
            own = [b.column(c).take(pa.array(rows)) for c in ("g", "id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cls.view(np.int64)), lists], names=["g", "id", "cls", "elements"])

    return df.select("g", "id", "text").mapInArrow(run, "g string, id long, cls long, elements array<int>")


def _document_frequencies(classes: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Documents (copies included) per element-hash bucket, 2**bits numbers, and the number of documents.

    Elements that share a bucket share its count, so a bucket count is an upper bound of a frequency; bits must grow
    with the vocabulary (18 bits hold 260,000 shingles apart, 24 bits 16 million in 64 MB).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            n, lists = b.column("n").to_numpy(), b.column("elements")
            bucket = (lists.flatten().to_numpy().view(np.uint32) >> np.uint32(32 - bits)).astype(np.int64)
            total += np.bincount(bucket, weights=np.repeat(n, np.diff(lists.offsets.to_numpy())), minlength=1 << bits).astype(np.int64)
            docs += int(n.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]]), pa.int64()), pa.array(np.concatenate([total[at], [docs]]), pa.int64())], names=["bucket", "n"])

    rows = classes.select("elements", "n").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(1 << bits, np.float32)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket == -1].sum())


def _sample_values(element: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """ln(a) of improved consistent weighted sampling: one row per element, one column per sample, as float32 bits.

    The variables of a sample hang on the element's hash alone, so that equal elements draw equal values everywhere.
    The least value of a document's elements is at once the sample: it tells element and quantized weight.
    """
    base = _mix(element[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    draws = []
    for _ in range(3):
        base = _mix(base + np.uint64(0x9E3779B97F4A7C15))
        draws += [((base >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32), ((base & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)]
    r = -np.log(draws[0] * draws[1])
    ln_c = np.log(-np.log(draws[2] * draws[3]))
    beta = draws[4]
    t = np.floor(np.log(weight)[:, None] / r + beta)
    return (ln_c - r * (t - beta) - r).astype(np.float32)


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Larger batches of about so many rows: values of the elements they share are drawn once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Least:
    """Least value of each document's elements, for several columns of values at once.

    Documents are sorted by length and met position by position, so that one read of an element's row serves all
    columns; long ones, of which few share a position, go one column at a time."""

    def __init__(self, inv: np.ndarray, sizes: np.ndarray) -> None:
        starts = np.cumsum(sizes) - sizes
        self.n, self.long = len(sizes), np.flatnonzero(sizes > LONG_TEXT)
        short = np.flatnonzero(sizes <= LONG_TEXT)
        self.order = short[np.argsort(-sizes[short], kind="stable")]
        lengths = -sizes[self.order]
        self.at = [inv.take(starts[self.order[: np.searchsorted(lengths, -p)]] + p) for p in range(-lengths[0] if len(short) else 0)]
        self.rest = inv[np.repeat(sizes > LONG_TEXT, sizes)]
        self.rest_starts = np.cumsum(sizes[self.long]) - sizes[self.long]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """values: a row per different element; the result has a row per document."""
        out = np.empty((self.n, values.shape[1]), values.dtype)
        if self.at:
            least = values.take(self.at[0], axis=0)
            for at in self.at[1:]:
                np.minimum(least[: len(at)], values.take(at, axis=0), out=least[: len(at)])
            out[self.order] = least
        if len(self.long):
            for i in range(values.shape[1]):
                out[self.long, i] = np.minimum.reduceat(values[:, i].take(self.rest), self.rest_starts)
        return out


def _sketches(element: np.ndarray, least: _Least, seed: int) -> np.ndarray:
    """SKETCH_BITS bits per document, one of each of so many least hashes: two documents differ in a bit with chance (1 - similarity) / 2."""
    out = np.zeros((least.n, len(SKETCH)), np.uint64)
    for j in range(0, SKETCH_BITS, 8):
        salts = np.uint64(seed) + np.uint64(104729) * np.arange(j + 1, j + 9, dtype=np.uint64)
        h = (_mix(element[:, None] * np.uint64(0xD6E8FEB86659FD93) + salts[None, :]) >> np.uint64(32)).astype(np.uint32)
        for i, bit in enumerate((least(h) & np.uint32(1)).astype(np.uint64).T, j):
            out[:, i >> 6] |= bit << np.uint64(i & 63)
    return out


def _sketch_limit(threshold: float) -> int:
    """Differing bits that a pair at the threshold exceeds with a chance of about 0.0003."""
    p = (1 - threshold) / 2
    return int(SKETCH_BITS * p + 3.7 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _turns(cfg: NearDupConfig) -> list[tuple[int, int]]:
    """First band and the one after the last of each turn."""
    n = min(TURNS, cfg.bands)
    ends = [cfg.bands * t // n for t in range(n + 1)]
    return list(zip(ends[:-1], ends[1:]))


def _keyed(classes: DataFrame, freq: np.ndarray, docs: int, cfg: NearDupConfig) -> DataFrame:
    """(cls, elements, sketch, k0, k1, ...): for each class a list of the keys of its bands for each turn.

    A key is 48 bits of a hash of the band's number and samples, then 16 bits of the class's size. 48 bits are enough:
    15 billion keys meet by chance in less than a million pairs, which are verified. Sizes from 65,535 elements on count
    as that. With equal weights a sample is a least hash, so that its bits serve the sketch as well; samples by weight
    don't tell the similarity that is verified, hence the sketch has hashes of its own there.
    """
    shift = np.uint32(32 - cfg.df_bits)
    shared = classes.sparkSession.sparkContext.broadcast(freq) if cfg.idf_power else None
    turns = _turns(cfg)
    own_sketch = bool(cfg.idf_power) or cfg.bands * cfg.rows_per_band < SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches, 20_000):
            if b.num_rows:
                el = b.column("elements").flatten().to_numpy().view(np.uint32)
                sizes = np.diff(b.column("elements").offsets.to_numpy())
                uniq, inv = np.unique(el, return_inverse=True)
                least = _Least(inv, sizes)
                weight = np.ones(len(uniq), np.float32)
                if shared:
                    weight = ((1 + np.log((1 + docs) / (1 + shared.value[uniq >> shift]))) ** cfg.idf_power).astype(np.float32)
                uniq = uniq.astype(np.uint64)
                keys = np.empty((len(sizes), cfg.bands), np.uint64)
                sketch = _sketches(uniq, least, cfg.seed) if own_sketch else np.zeros((len(sizes), len(SKETCH)), np.uint64)
                for j in range(cfg.bands):  # samples of one band at a time bound the memory
                    samples = least(_sample_values(uniq, weight, cfg.rows_per_band, cfg.seed + 7919 * j)).view(np.uint32).astype(np.uint64)
                    key = np.full(len(sizes), j + 1, np.uint64)
                    for no, sample in enumerate(samples.T, j * cfg.rows_per_band):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sample)
                        if not own_sketch and no < SKETCH_BITS:
                            sketch[:, no >> 6] |= (_mix(sample + np.uint64(no + 1)) & np.uint64(1)) << np.uint64(no & 63)
                    keys[:, j] = (key & ~np.uint64(0xFFFF)) | np.minimum(sizes, 0xFFFF).astype(np.uint64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (to - at)), pa.array(keys[:, at:to].ravel().view(np.int64))) for at, to in turns]
                bits = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sketch.T]
                out = pa.RecordBatch.from_arrays([b.column("cls"), b.column("elements"), *bits, *lists], names=["cls", "elements", *SKETCH, *(f"k{t}" for t in range(len(turns)))])
                for at in range(0, out.num_rows, 4_000):  # the JVM holds one batch at a time
                    yield out.slice(at, 4_000)

    columns = ["cls long", "elements array<int>", *(f"{c} long" for c in SKETCH), *(f"k{t} array<long>" for t in range(len(turns)))]
    return classes.select("cls", "elements").mapInArrow(run, ", ".join(columns))


def _candidates(keyed: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Different pairs (a, b), a < b, of classes that meet in a band and may reach the threshold by size and sketch.

    The rows of the bands are many times the input, so bands meet in turns and each turn's shuffle files go before the
    next: what lies on disk at a time is one turn. The sketch is wide, as unlike texts that meet by chance grow as the
    square of the corpus: hardly one below a similarity of 0.4 comes out of its turn.
    """
    columns = [f"k{t}" for t in range(len(_turns(cfg)))]
    found = []
    for turn in [[c] for c in columns] if keyed.count() > ONE_TURN else [columns]:
        bands = keyed.select(F.explode(F.concat(*turn)).alias("band"), "cls", *SKETCH)
        left, right = (bands.select(F.col("band").alias(f"k{c}"), F.col("cls").alias(c), *(F.col(s).alias(f"{s}{c}") for s in SKETCH)) for c in "ab")
        na, nb = (F.col(f"k{c}").bitwiseAND(F.lit(0xFFFF)) for c in "ab")
        # sets of too different sizes cannot reach the threshold, and those of too different sketches hardly ever
        pairs = left.join(right, F.shiftright("ka", 16) == F.shiftright("kb", 16))
        pairs = pairs.where((F.col("a") < F.col("b")) & (F.least(na, nb) >= F.lit(cfg.threshold) * F.greatest(na, nb) - F.lit(1e-9)))
        pairs = pairs.where(sum(F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in SKETCH) <= _sketch_limit(cfg.threshold))
        # similar classes meet in many bands, so most of their repeats go before the shuffle
        found.append(materialize(pairs.select("a", "b").dropDuplicates(["a", "b"]), "neardup_pairs", keep_shuffles=False))
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"])


def _verified(pairs: DataFrame, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Pairs of classes whose weighted Jaccard similarity over shingle counts reaches the threshold."""
    c = classes.select("cls", "elements")
    a = pairs.join(c.select(F.col("cls").alias("a"), F.col("elements").alias("ea")), "a")
    both = a.join(c.select(F.col("cls").alias("b"), F.col("elements").alias("eb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            la, lb = b.column("ea"), b.column("eb")
            na, nb = np.diff(la.offsets.to_numpy()), np.diff(lb.offsets.to_numpy())
            no = np.arange(b.num_rows, dtype=np.uint64) << np.uint64(32)
            # within a pair, an element that occurs twice is in both sets
            x = np.concatenate([la.flatten().to_numpy().view(np.uint32) + np.repeat(no, na), lb.flatten().to_numpy().view(np.uint32) + np.repeat(no, nb)])
            x.sort()
            twice = x[1:][x[1:] == x[:-1]]
            shared = np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
            union = na + nb - shared
            ok = pa.array(np.flatnonzero(shared >= cfg.threshold * union - 1e-9))
            sim = pa.array(shared / np.maximum(1, union))
            yield pa.RecordBatch.from_arrays([b.column("a").take(ok), b.column("b").take(ok), sim.take(ok)], names=["a", "b", "similarity"])

    return both.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, similarity double")


def near_duplicate_classes(df: DataFrame, group: str, id_col: str, text: str, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (group, id, cls) of all texts with min_words words, links (a, b, similarity), a < b.

    Texts of the same shingles form one class, by a 64-bit hash of their elements. Null and empty texts, and shorter
    ones than min_words, have no class. Repeated rows count once. An empty input gives empty results. Links are the
    pairs of classes whose similarity reaches the threshold, as found through at least one band in common. A hot band
    is a plain sort-merge join of two shuffles, which AQE splits.
    """
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    rows = rows.where(F.length("text") >= 2 * cfg.min_words - 1)  # a word has a letter and a blank after it
    tokens = materialize(_tokenized(rows, cfg), "neardup_tokens")
    members = materialize(tokens.select(F.col("g").alias(group), F.col("id").alias(id_col), "cls").distinct(), "neardup_members", keep_shuffles=False)
    classes = tokens.where(F.col("elements").isNotNull() & F.col("cls").isNotNull()).select("cls", "elements").repartition("cls").groupBy("cls").agg(F.max("elements").alias("elements"))
    freq, docs = np.zeros(0, np.float32), 0
    if cfg.idf_power:
        rows_of = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
        freq, docs = _document_frequencies(classes.join(rows_of, "cls"), cfg.df_bits)
    keyed = materialize(_keyed(classes, freq, docs, cfg), "neardup_classes", keep_shuffles=False)
    discard(tokens)
    return members, _verified(_candidates(keyed, cfg), keyed, cfg)


def near_duplicate_pairs(df: DataFrame, group: str, id_col: str, text: str, cfg: NearDupConfig) -> DataFrame:
    """Pairs (group, id_a, id_b), id_a < id_b, of different rows of one group that are near or exact copies."""
    members, links = near_duplicate_classes(df, group, id_col, text, cfg)
    links = materialize(links.select("a", "b"), "neardup_links", keep_shuffles=False)
    a = members.select(group, F.col("cls").alias("a"), F.col(id_col).alias("_ia"))
    b = members.select(group, F.col("cls").alias("b"), F.col(id_col).alias("_ib"))
    between = a.join(links, "a").join(b, [group, "b"]).where(F.col("_ia") != F.col("_ib"))
    within = a.join(b.withColumnRenamed("b", "a"), [group, "a"]).where(F.col("_ia") < F.col("_ib"))
    pair = [F.col(group), F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b")]
    return between.select(*pair).unionByName(within.select(*pair)).distinct()


def near_duplicate_groups(df: DataFrame, group: str, id_col: str, text: str, cfg: NearDupConfig) -> DataFrame:
    """(group, id, class_id, group_id, links): one row per text with its class, its group of linked classes, and links.

    A group is a connected component of the links between classes; a class without links is a group of its own. Exact
    copies share a class and are not expanded into pairs; links counts the other classes that the text's class is
    similar to. Components are found in rounds over tables in the shared folder.
    """
    members, links = near_duplicate_classes(df, group, id_col, text, cfg)
    links = materialize(links.select(F.lit(0).alias("p"), "a", "b"), "neardup_links", keep_shuffles=False)
    comps = connected_components(links, "p", "a", "b").select(F.col("node").alias("cls"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(comps, "cls", "left").join(degree, "cls", "left")
    return out.select(group, id_col, F.col("cls").alias("class_id"), F.coalesce("component", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
