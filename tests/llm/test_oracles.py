"""The queries that have SQL, against DuckDB."""

import duckdb
import pytest

from sparkvista.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()), key=str) and got
