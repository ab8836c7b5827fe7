"""Every domain query against its SQL in DuckDB."""

import duckdb
import pytest

from tamarind import catalog as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(r)) for r in df.collect())
    made = duck.execute(queries.SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    plain = lambda v: int(v) if type(v).__name__ == "Decimal" else v
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in made.fetchall())
