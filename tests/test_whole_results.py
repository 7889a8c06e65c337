"""Queries over small written tables, where a cut would lose results."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import governance
from palimpsest.plans import graph_queries, lifecycle_queries, retrieval_queries

SF = "/root/testdata/sf0.001"


def test_blind_index_covers_every_token(spark, tmp_path):
    words = [f"word{i}" for i in range(50)]
    rows = [(1, " ".join(words + words[:5])), (2, "word49"), (3, None), (4, "")]
    spark.createDataFrame(rows, "memory_id long, text string").write.parquet(f"{tmp_path}/memories.parquet")
    got = graph_queries.blind_index_terms(spark, str(tmp_path))
    assert got.groupBy("memory_id").count().orderBy("memory_id").collect() == [(1, 50), (2, 1)]
    last = spark.range(1).select(governance.hmac_sha256(F.lit("word49"), b"index-key")).first()[0]
    assert {r.memory_id for r in got.where(F.col("term") == last).collect()} == {1, 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_hashed_neighbours_on_the_embeddings_table(spark):
    want = {(r.query, r.id) for r in lifecycle_queries.cosine_topk(spark, SF).collect()}
    found = {(r.query, r.id) for r in lifecycle_queries.sign_hash_candidates(spark, SF).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_consolidation_finds_edits_at_the_start(spark, tmp_path):
    w = [f"tok{chr(97 + i)}" for i in range(12)]
    texts = {1: w, 2: ["changed", *w[1:]], 3: list(reversed(w)), 4: [*w[:9], "x", "y", "z"], 5: ["alpha", "beta"], 6: ["beta", "alpha"], 7: w}
    rows = [(i, "s" if i != 7 else "t", 0.5, " ".join(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "memory_id long, scope string, mass double, text string").write.parquet(f"{tmp_path}/memories.parquet")
    got = {(r.kept, r.merged) for r in retrieval_queries.consolidation_pairs(spark, str(tmp_path)).collect()}
    sets = {i: set(t) for i, t in texts.items() if i != 7}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} == {(1, 2), (1, 3), (2, 3), (5, 6)}
