"""Connected components of long chains and random graphs, against a plain search."""

import random

from palimpsest.operators.graph import connected_components


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(300)] + [(300, -1)]
    wild = [(1000 + r.randrange(80), 1000 + r.randrange(80)) for _ in range(60)]
    for edges in (chain, [e for e in wild if e[0] != e[1]]):
        df = spark.createDataFrame([("p", *e) for e in edges], "p string, a long, b long")
        assert {x.node: x.component for x in connected_components(df, "p", "a", "b").collect()} == plain(edges)
    assert connected_components(df.limit(0), "p", "a", "b").count() == 0


def test_parts_stay_apart(spark):
    df = spark.createDataFrame([("p", 1, 2), ("q", 2, 3), ("q", 3, 3)], "p string, a long, b long")
    assert sorted((x.p, x.node, x.component) for x in connected_components(df, "p", "a", "b").collect()) == [("p", 1, 1), ("p", 2, 1), ("q", 2, 2), ("q", 3, 2)]
