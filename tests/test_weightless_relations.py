"""Relations without weight: spreading ends as the SQL does, whether their subject is active or not."""

import duckdb

from palimpsest.plans import formula_queries as Q


def test_kinds_without_weight_are_no_error(spark, tmp_path):
    rows = [
        (1, "a", "reports to", "b", 0.5), (2, "a", "works at", "c", 1.0), (3, "b", "depends on", "d", 0.25), (4, "x", "hosted by", "y", 0.0), (5, "c", "works at", "e", None),
        (6, "f", "reports to", "g", 0.0), (7, "g", "member of", "h", 0.3), (8, "x", "works at", "c", 0.0), (9, "x", "works at", "e", 0.0),
    ]
    for name, some in (("inactive", [r for r in rows if r[0] != 6]), ("active", rows)):
        path = str(tmp_path / name)
        spark.createDataFrame(some, "relation_id long, subject string, predicate string, object_value string, confidence double").write.parquet(f"{path}/entity_relations.parquet")
        got = sorted((r.node, str(r.activation)) for r in Q.spread_activation(spark, path).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW entity_relations AS SELECT * FROM '{path}/entity_relations.parquet/*.parquet'")
        assert got == sorted((n, str(a)) for n, a in con.execute(Q.SQL["spread_activation"]).fetchall())
        assert any(a == "nan" for _, a in got) == (name == "active")
