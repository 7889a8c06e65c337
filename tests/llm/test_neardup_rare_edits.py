"""Near copies whose edited words are rare: misspellings weigh most under inverse document frequencies."""

import random

from palimpsest.llm.neardup import near_duplicate_pairs
from palimpsest.llm.p1_queries import CONFIG
from tests.llm.test_neardup import brute


def test_misspelled_words_match_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(150):
        d = [vocab[min(2999, int(r.paretovariate(0.5)))] for _ in range(80)]
        e = list(d)
        for j in r.sample(range(80), 14):  # 66 of 94 words stay: 0.702
            e[j] = f"{e[j]}x{i}y{j}"
        docs += [" ".join(d), " ".join(e)]
    rows = [("w", i, t) for i, t in enumerate(docs)]
    got = {tuple(x) for x in near_duplicate_pairs(spark.createDataFrame(rows, "src string, id long, text string"), "src", "id", "text", CONFIG).collect()}
    want = brute(rows, 30, 0.7)
    assert len(want) >= 150 and got <= want and len(got) >= 0.985 * len(want)
