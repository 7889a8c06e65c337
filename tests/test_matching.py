"""Identities, rare-term bridges and positions on small tables."""

from pyspark.sql import functions as F

from palimpsest.functions.encoders import hash_encoder
from palimpsest.operators import lexical as L
from palimpsest.operators import retrieval as R


def test_identities(spark):
    rows = [("s", 1, "Northwind Traders", "org"), ("s", 2, "northwind traders", "org"), ("s", 3, "Southgate Bank", "org"), ("t", 4, "northwind traders", None), ("s", 5, None, "org")]
    df = spark.createDataFrame(rows, "p string, i int, n string, k string").withColumn("v", hash_encoder(64)(F.col("n")))
    merged, unsure = R.identity_matches(df, "p", "i", "n", "k", "v")
    assert [(r.i, r.same_as) for r in merged.collect()] == [(2, 1)] and unsure.count() == 0


def test_rare_terms_lead_to_other_rows(spark):
    uses = spark.createDataFrame([(1, "quasar", 1), (2, "quasar", 3), (1, "common", 1), (2, "common", 1), (3, "common", 1), (4, "lonely", 1)], "d int, term string, tf int")
    seeds = spark.createDataFrame([("q", 1, 1, ["common"])], "q string, d int, rank int, own array<string>")
    assert [(r.d, r.bridge) for r in L.rare_bridge(uses, seeds, "q", "d").collect()] == [(2, 1.0)]


def test_positions_do_not_depend_on_buckets(spark):
    df = spark.range(50).selectExpr("id % 2 g", "id i", "id div 7 b")
    a = sorted((r.i, r.position, r["size"]) for r in L.positions(df, "g", ["i"], F.col("b")).collect())
    assert a == [(i, i // 2, 25) for i in range(50)]
