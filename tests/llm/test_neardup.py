"""Near copies against all-pairs brute force."""

import random
import re
from collections import Counter

from palimpsest.llm.neardup import NearDupConfig, near_duplicate_classes, near_duplicate_groups, near_duplicate_pairs

SCHEMA = "src string, id long, text string, cls string, elements string"
CFG = NearDupConfig(words_per_shingle=1, threshold=0.7, min_words=30, bands=52, rows_per_band=6)


def words(t):
    return Counter(re.findall(r"[^\W_]+", t.lower()))


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    docs = [[r.choice(vocab) for _ in range(r.randrange(20, 80))] for _ in range(n)]
    for d in docs[: n // 2]:
        e = list(d)
        for _ in range(r.randrange(0, len(e) // 3)):
            e[r.randrange(len(e))] = r.choice(vocab)
        r.shuffle(e)
        docs.append(e)
    return [" ".join(d) for d in docs]


def brute(rows, least, share):
    out = set()
    for i, (s, a, t) in enumerate(rows):
        for u, b, v in rows[i + 1 :]:
            if s == u and a != b and t and v:
                x, y = words(t), words(v)
                if min(sum(x.values()), sum(y.values())) >= least and sum((x & y).values()) >= share * sum((x | y).values()) - 1e-9:
                    out.add((s, min(a, b), max(a, b)))
    return out


def test_pairs_match_brute_force(spark):
    rows = [("w", i, t) for i, t in enumerate(corpus(1))] + [("m", i, t) for i, t in enumerate(corpus(1)[:20])]
    k = next(i for i, r in enumerate(rows) if sum(words(r[2]).values()) >= 40 and i < 20)
    rows += [("w", 900, None), ("w", 901, ""), ("w", 902, "one two"), ("w", k, rows[k][2]), ("w", 950, rows[k][2].upper() + "!"), ("m", 951, rows[k][2])]
    df = spark.createDataFrame([(*x, "c", "e") for x in rows], SCHEMA)
    got = {tuple(r) for r in near_duplicate_pairs(df, "src", "id", "text", CFG).collect()}
    want = brute(rows, 30, 0.7)
    assert got <= want and len(got) >= 0.99 * len(want) and ("w", k, 950) in got and ("m", k, 951) in got


def test_shingles_of_five_words_by_default(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near, far = base.replace("w100", "zzz"), " ".join(reversed(base.split()))
    df = spark.createDataFrame([("w", 1, base, "", ""), ("w", 2, near, "", ""), ("w", 3, far, "", ""), ("w", 4, "short", "", ""), ("w", 5, "short", "", "")], SCHEMA)
    assert {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "src", "id", "text", NearDupConfig()).collect()} == {(1, 2), (4, 5)}


def test_hot_group_of_copies_is_one_class(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(3000).selectExpr("'w' src", "id", f"'{text}' text")
    members, links = near_duplicate_classes(df, "src", "id", "text", CFG)
    assert members.select("cls").distinct().count() == 1 and members.count() == 3000 and links.count() == 0


def test_empty_and_very_long(spark):
    assert near_duplicate_pairs(spark.createDataFrame([], SCHEMA), "src", "id", "text", CFG).count() == 0
    long = " ".join(f"t{i % 5000}" for i in range(60000))
    df = spark.createDataFrame([("w", 1, long, "", ""), ("w", 2, long + " end", "", "")], SCHEMA)
    assert near_duplicate_pairs(df, "src", "id", "text", CFG).count() == 1


def test_groups_follow_links(spark):
    docs = [[f"w{i}" for i in range(40)]]
    for k in range(6):
        docs.append([w if i != k * 6 else f"new{k}" for i, w in enumerate(docs[-1])])
    rows = [("w", i, " ".join(d), "", "") for i, d in enumerate(docs)] + [("w", 50, " ".join(f"z{i}" for i in range(40)), "", ""), ("w", 51, rows_text(docs[0]), "", "")]
    got = {r.id: r for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "src", "id", "text", CFG).collect()}
    assert len({got[i].group_id for i in range(7)}) == 1 and got[50].group_id != got[0].group_id and got[50].links == 0
    assert got[51].class_id == got[0].class_id and got[0].links >= 1


def rows_text(d):
    return " ".join(reversed(d))
