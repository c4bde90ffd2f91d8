"""Corpus queries against their SQL in DuckDB."""

import duckdb
import pytest
from conftest import SMALL

from filmweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got, want = QUERIES[name](spark, SMALL), db.sql(ORACLE_SQL[name])
    order = sorted(want.columns)
    plain = lambda columns, rows: sorted(str([r[columns.index(c)] for c in order]) for r in rows)
    assert sorted(got.columns) == order and plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())
