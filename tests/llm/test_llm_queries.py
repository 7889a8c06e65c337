"""Every text query runs on the smallest tables with the columns that are asked for."""

import os

import pytest

from palimpsest.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
COLUMNS = {
    "p1_found": "src string, id_a bigint, id_b bigint", "p3_found": "src string, id_a bigint, id_b bigint", "p4_found": "src string, row_id bigint, pii_type string, pii_text string",
    "p5_found": "tenant_id string, scope string, name_a string, name_b string", "p9_found": "doc_id bigint, subject string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name] and len(set(rows)) == len(rows)
    assert name == "p1_found" or rows
