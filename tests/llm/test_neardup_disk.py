"""Near copies: what lies on disk and what is verified grows with the corpus, not with its square."""

import random

import numpy as np
import pytest

from palimpsest.llm import neardup
from palimpsest.llm.neardup import NearDupConfig, near_duplicate_classes, near_duplicate_pairs

CFG = NearDupConfig(words_per_shingle=1, threshold=0.7, min_words=30)


def templates(n, seed=3):
    """Texts of 50 words, any two with a similarity of about 0.3, and one near copy of each twentieth."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    docs = [[*r.sample(common, 38), *(f"w{r.randrange(10**6)}" for _ in range(12))] for _ in range(n)]
    docs += [[*d[:-3], "x", "y", "z"] for d in docs[::20]]
    return [("w", i, " ".join(d)) for i, d in enumerate(docs)]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_unlike_texts_hardly_reach_the_verification(spark, monkeypatch):
    seen, verified = [], neardup._verified

    def count(pairs, classes, cfg):
        seen.append(pairs.count())
        return verified(pairs, classes, cfg)

    monkeypatch.setattr(neardup, "_verified", count)
    df = spark.createDataFrame(templates(1500), "src string, id long, text string")
    _, links = near_duplicate_classes(df, "src", "id", "text", CFG)
    assert links.count() == 75 and seen[0] < 200


@pytest.mark.parametrize("one_turn", [10**9, 0])
def test_same_pairs_in_one_turn_and_in_several(spark, monkeypatch, one_turn):
    monkeypatch.setattr(neardup, "ONE_TURN", one_turn, raising=False)
    df = spark.createDataFrame(templates(200), "src string, id long, text string")
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "src", "id", "text", CFG).collect()}
    assert got == {(20 * i, 200 + i) for i in range(10)}


def test_shuffle_files_of_the_turns_are_gone(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ONE_TURN", 0, raising=False)
    df = spark.createDataFrame(templates(200), "src string, id long, text string")
    before = shuffle_files(spark)
    near_duplicate_classes(df, "src", "id", "text", CFG)
    assert not shuffle_files(spark) - before


def test_least_values_of_short_and_long_texts():
    r = np.random.default_rng(5)
    sizes = r.choice([1, 2, 40, neardup.LONG_TEXT, neardup.LONG_TEXT + 1, 2000], 50)
    inv, values = r.integers(0, 90, sizes.sum()), r.random((90, 7), np.float32)
    for keep in (sizes > 0, sizes <= 40, sizes > neardup.LONG_TEXT):
        own, at = sizes[keep], inv[np.repeat(keep, sizes)]
        want = np.minimum.reduceat(values[at], np.cumsum(own) - own, axis=0)
        assert np.array_equal(neardup._Least(at, own)(values), want)
