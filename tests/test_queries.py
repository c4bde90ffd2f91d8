"""Every named query against its SQL in DuckDB."""

import duckdb
import pytest
from conftest import SMALL

from filmweave.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events pages".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return db


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
