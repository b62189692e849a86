"""The registered queries on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from folioscope.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p1_found": ["meta_id", "field_name", "canon_id"],
    "p2_found": ["field_name", "term", "mark"],
    "p3_found": ["row_id_a", "row_id_b"],
    "p4_found": ["row_id", "paper_id"],
    "p5_found": ["kind", "name_a", "name_b"],
    "p5_entities": ["kind", "name", "entity"],
    "p7_ids": ["doc_id", "ids"],
    "p8_containers": ["container_id", "doc_id", "part", "start", "n_tokens", "place"],
    "p9_found": ["doc_id_a", "doc_id_b"],
    "p9_lines": ["doc_id", "start", "n_chars"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and (name == "p7_ids" or len(rows) == len(set(rows)))


def test_keywords_equal_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW openreview_papers AS SELECT * FROM '{small}/openreview_papers.parquet'")
    want = con.sql(ORACLE_SQL["p2_keywords"])
    got = QUERIES["p2_keywords"](spark, small).select(*want.columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())
