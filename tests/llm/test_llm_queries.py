from __future__ import annotations

import pytest
SF = "/root/testdata/sf0.001"

from papyra.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["field_name", "id_a", "id_b"], "p3_found": ["block_id"], "p4_found": ["field_name", "record_id"],
    "p6_found": ["path", "paragraph_id", "source_hash", "lang"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_the_smallest_tables(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    n = df.count()
    if name in COLUMNS:
        assert n > 0 and df.distinct().count() == n
