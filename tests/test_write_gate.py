"""The write gate compares a write with all earlier ones of its scope."""

import datetime as dt

from palimpsest.plans import lifecycle_queries


def test_redundancy_is_the_greatest_overlap_of_earlier_writes(spark, tmp_path):
    texts = [("a", "red green blue"), ("a", "one two three"), ("a", "red green blue"), ("a", "one two four five"), ("b", "red green blue"), (None, "six seven"), (None, "nine"), (None, "six seven")]
    rows = [(i, "t", s, x, "user", 0.5, ["e"], dt.datetime(2025, 1, 1 + i), dt.datetime(2025, 1, 1 + i)) for i, (s, x) in enumerate(texts)]
    schema = "write_id long, tenant_id string, scope string, text string, source string, explicit_importance double, entities array<string>, written_at timestamp, received_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/memory_writes.parquet")
    got = {r.write_id: r.redundancy for r in lifecycle_queries.write_gate(spark, str(tmp_path)).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.4, 4: 0.0, 5: 0.0, 6: 0.0, 7: 1.0}
