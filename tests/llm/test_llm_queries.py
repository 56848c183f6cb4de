from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from presswerk.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries(spark, folder, name):
    df = Q.queries()[name](spark, folder)
    got = sorted(map(tuple, df.collect()), key=str)
    assert name == "p8_ids" or len(set(got)) == len(got)
    sql = Q.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            c.sql(f'CREATE VIEW "{p.stem}" AS SELECT * FROM \'{p}\'')
        rel = c.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        order = [rel.columns.index(x) for x in df.columns]
        assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)


COLUMNS = {
    "p1_found": [("id", "bigint")], "p2_found": [("id", "bigint"), ("line_no", "bigint")], "p3_found": [("id", "bigint")], "p4_found": [("url_hash", "string"), ("group_key", "string")], "p6_found": [("id", "bigint"), ("line_no", "bigint")],
    "p7_found": [("id", "bigint"), ("line_no", "bigint"), ("lang", "string")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
    "p9_passages": [("doc_id", "bigint"), ("item_id", "bigint"), ("run", "int"), ("errors", "int")],
}


def test_columns(spark, folder):
    for name in ("p3_found", "p6_found", "p8_ids", "p9_found"):
        assert Q.queries()[name](spark, folder).dtypes == COLUMNS[name]
    assert set(COLUMNS) == set(Q.queries())
